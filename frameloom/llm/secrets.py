"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least 16 key characters that has a digit, one of the known key forms (with or without a digit), or a value of any length that
is assigned to a name which ends in a key word (quoted: up to the closing quote, blanks as one; bare: up to white space, another such assignment, or a separator before
another name). Each assignment counts, also several in one word or inside a quoted value. Words end at white space, at any of ``, ; & { }`` and after a run of key characters. The time is linear in a text's length. The forest judges it by its length, its
transitions between character classes, its shares of digits, capitals, vowels, symbols and distinct characters, the share of it that a dictionary covers,
the path it stands in (documents without one are judged by what ``path_col`` names instead, as their source), and the words before and after it. Forests are grown on a bounded table of labelled findings and walked as constant arrays, so that the scan is a single map of built-in functions over the texts.

Labelled findings come as a table (``candidate, before, path, label``, and ``after`` if it has one); without one, :func:`sample_findings` makes a fixed, seeded table of the usual key forms and of
what is often taken for them (digests of commits and files, identifiers, long words, numbers, addresses, placeholders).

Results: a null or empty text has no candidate. Candidates come in text order with their word number; in
a word, known forms and assigned values that are no such run follow the runs. Repeated rows each report theirs. A null path is
an empty one. Found keys aren't returned: a finding carries the SHA-256 of its candidate.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Trees, their depth, and labelled findings that a fit may read.
TREES, DEPTH, MAX_FINDINGS = 25, 8, 20_000
FEATURES = ("length", "transitions", "digits", "capitals", "vowels", "distinct", "hexadecimal", "covered", "key_words", "other_words", "assigned", "test_path", "known_form", "symbols", "key_after", "other_after")

# Word lists and key forms.
DICTIONARY = "about access account action address admin after again agent alpha and apache api application array article async attr auth back base batch before block body book branch buffer build byte cache call case chain change char check class clean client clock close cloud code color column command comment commit common config connect const container content context control copy core count create current custom data database date debug default define delete deploy desc detail device digest direct disk docs document domain down drive driver element email empty enable encode end engine enter entry error event example exec export extend factory false fetch field file filter final find first flag float folder font form format frame from function get global graph group handle hash head header health height hello help hidden high home host html http image import index info init input insert install instance int integer interface internal item java join json key kind label language last layer layout length level library license line link list load local lock log login long loop machine main make manager map mask match max media member memory menu merge message meta method min mobile mode model module monitor more mount move name native network new next node none note null number object offset online open option order out output over package page panel param parent parse pass password path pattern pixel place player plugin point policy pool port post prefix press print private process product profile program project property protocol provider proxy public push query queue random range read record release remote remove render replace report request reset resource response result return role root route rule run sample save scale schema scope screen script search secret section select send sequence server service session set shape share show side sign simple size small sort source space spark spec split stack stage start state static status step stop storage store stream string style sub submit success suffix sum support switch sync system tab table tag target task team template term test text theme thread time title token tool total track transform tree true type union unique unit update upload url user util valid value variable vector version video view virtual visit watch web width window word work world wrap write zone".split()
KEY_WORDS = "secret|token|passw|pwd|api|key|auth|credential|private|bearer|access|signature"
OTHER_WORDS = "commit|sha|md5|hash|checksum|digest|uuid|guid|revision|etag|example|sample|placeholder|version|build|http|href|path|file|card|phone|order|invoice"
KNOWN_FORMS = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^sk_(live|test)_[A-Za-z0-9]{16,}$|^xox[abpr]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{35}$|^eyJ[A-Za-z0-9_-]{10,}|^glpat-[A-Za-z0-9_-]{20}$"
#: The same forms inside a word.
KNOWN_INSIDE = "(?<![A-Za-z0-9])(?:" + "|".join(f.strip("^$") for f in KNOWN_FORMS.split("|^")) + ")(?![A-Za-z0-9])"
#: A name that ends in a key word, with what may close it; and what assigns.
NAME, ASSIGN = r"(?:secret|token|passw(?:(?!passw)[a-z])*+|passphrase|pwd|key|credentials?|auth|bearer|signature|access|private)[\"'\])]*+", r"(?::=|=>|==?|:)"
NAMED = rf"(?i){NAME}\s*+{ASSIGN}"
#: An assigned value: quoted, or bare. A quote or separator inside a bare one needs a word after it that isn't assigned to.
VALUE = rf"\"([^\"]+)\"|'([^']+)'|((?![\"'])(?:(?!{NAME}{ASSIGN}[^\s=:>])(?:[^\s\"'&,;]|[&,;](?![\"']?[\w.\-]++[\"']?\s*+[=:])|[\"'](?=\w)))++)"
#: Marks in a scanned text (code points that no text holds; if one does, they count as another): around a copied value, before its bare form, after a run.
OPEN, BARE, SHUT, CUT, LOST = "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4"
#: A word of a marked text: a copied value and what follows it, or what stands between white space, separators and marks.
WORD = rf"{OPEN}[^{SHUT}]*+{SHUT}[^\s,;&{{}}{OPEN}{CUT}]*+|[^\s,;&{{}}{OPEN}{CUT}]++"
TEST_PATH = "test|example|sample|fixture|mock|docs?/|readme"


def features(candidate: Column, before: Column, path: Column, after: Column) -> list[Column]:
    """The feature columns of a candidate, in the order of ``FEATURES``."""
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    classes = F.translate(candidate, low + up + num, "a" * 26 + "A" * 26 + "9" * 10)

    def share(pattern: str) -> Column:
        return F.regexp_count(candidate, F.lit(pattern)) / n

    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    context, follows = (F.lower(F.coalesce(c, F.lit(""))) for c in (before, after))
    return [
        n,
        (F.regexp_count(classes, F.lit("a+|A+|9+|[^aA9]+")) - 1) / n,
        share("[0-9]"), share("[A-Z]"), share("[aeiouAEIOU]"),
        F.size(F.array_distinct(F.split(candidate, ""))) / n,
        flag(candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        1 - F.length(F.regexp_replace(F.lower(candidate), words, "")) / n,
        flag(context.rlike(KEY_WORDS)), flag(context.rlike(OTHER_WORDS)), flag(context.rlike("[:=]\\s*[\"']?$")),
        flag(F.lower(F.coalesce(path, F.lit(""))).rlike(TEST_PATH)),
        flag(candidate.rlike(KNOWN_FORMS)),
        share("[^A-Za-z0-9]"),
        flag(follows.rlike(KEY_WORDS)), flag(follows.rlike(OTHER_WORDS)),
    ]


def sample_findings(count: int = 3000, seed: int = 11) -> list[tuple[str, str, str, int, str]]:
    """A seeded table of labelled findings: ``(candidate, before, path, label, after)``.

    The words that follow are those of prose or of the next assignment; of some findings that are none, the word that names them follows instead of preceding.
    """
    rng = random.Random(seed + 1)
    out = []
    for candidate, before, path, label in _findings(count, seed):
        after = rng.choice(["", "and then", "host =", "the value", "# set", "timeout: 30", "} ]", "user ="])
        if not label and rng.random() < 0.15 and any(w in before for w in ("commit", "checksum", "digest", "revision", "build")):
            before, after = "see the ", rng.choice(["commit of", "checksum", "(digest)", "revision", "build"])
        out.append((candidate, before, path, label, after))
    return out


def _findings(count: int, seed: int) -> list[tuple[str, str, str, int]]:
    """Findings without what follows them."""
    rng = random.Random(seed)
    hexa, word = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    plain = lambda: " ".join(rng.sample("the of value item run see this with note for and was here line set data".split(), 2))
    cased = lambda s: s.upper() if rng.random() < 0.2 else s
    out = []
    for _ in range(count):
        path = rng.choice(["src/app", "conf/prod", "web", "", "tests/unit", "docs/readme", "lib/io", "deploy/stage.yml"])
        tail = rng.choice([' = "', ": ", "=", ' : "', ":", " = '", " "])
        if rng.random() < 0.5:
            name = rng.choice("token secret api_key apikey password auth_token access_key client_secret private_key bearer API_TOKEN db_password".split())
            kind = rng.randrange(6)
            value = (cased(some(hexa, rng.choice([32, 40, 40, 64]))), some(word + "+/", rng.choice([32, 40, 44])), "AKIA" + some(word[26:], 16).upper(), "ghp_" + some(word, 36), "sk_live_" + some(word, 24), some(word, rng.randint(20, 36)))[kind]
            before = plain() + (" " if rng.random() < 0.5 else "\n") + cased(name) + tail if kind not in (2, 3, 4) or rng.random() < 0.6 else plain() + " "
            out.append((value, before, path, int("test" not in path)))
            continue
        kind = rng.randrange(8)
        name = rng.choice("commit sha sha256 md5 checksum digest revision etag build".split())
        parts = rng.sample(DICTIONARY, rng.randint(3, 5))
        value = (
            some(hexa, rng.choice([32, 40, 64])),
            "-".join([some(hexa, 8), some(hexa, 4), some(hexa, 4), some(hexa, 4), some(hexa, 12)]),
            "_".join(parts) + rng.choice(["", "_2", "_v1", "64"]),
            "".join(p.title() for p in parts) + str(rng.randrange(100)),
            "/".join(parts) + "/" + str(rng.randrange(10000)),
            some("0123456789", rng.choice([16, 16, 18, 20])),
            rng.choice(["x", "0", "A", "your", "EXAMPLE"]) * rng.randint(5, 20) + "1234567890",
            "".join(rng.choice("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()) for _ in range(rng.randint(9, 20))) + rng.choice(["1", "22", "3", ""]),
        )[kind]
        before = plain() + " " + cased(name) + tail if kind in (0, 1) else plain() + rng.choice([" ", " id: ", " = ", "\n", " card ", " order "]) if kind != 6 else plain() + " api_key" + tail
        out.append((value, before, path, 0))
    return out + _assigned_findings(count // 2, rng)


def _assigned_findings(count: int, rng: random.Random) -> list[tuple[str, str, str, int]]:
    """Known key forms without a digit, and short values assigned to key words: passwords, and what is none (words, types, references, placeholders)."""
    capitals, letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    some = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    out = []
    for _ in range(count):
        path = rng.choice(["src/app", "conf/prod", "web", "", "tests/unit", "lib/io", "deploy/stage.yml"])
        name = rng.choice("token secret api_key password auth_token access_key client_secret PASSWORD db_password passwd pwd".split())
        before = "set " + name + rng.choice([' = "', ": ", "=", '="', " = '", " := "])
        kind = rng.randrange(8)
        words = rng.sample(DICTIONARY, 3)
        if kind < 2:
            value = ("AKIA" + some(capitals, 16), "sk_live_" + some(letters, 24))[kind]
            before = before if rng.random() < 0.5 else "run of this "
        elif kind < 5:
            value = (
                some(letters + "0123456789!@#$%&*?^", rng.randint(8, 15)),
                rng.choice([words[0], words[0].title()]) + rng.choice(["", "!", "#", "@", "_"]) + str(rng.randrange(10, 10000)) + rng.choice(["", "!", "$"]),
                some(letters, rng.randint(9, 15)) + rng.choice(["", "!", "#9", "$7x"]),
            )[kind - 2]
        else:
            value = (
                rng.choice([words[0], words[0].title(), words[0].upper(), "_".join(words[:2]), " ".join(words), "-".join(words[:2]), "string", "null", "None", "true", "false", "required", "the", "a", "it", "this", "***", "xxxx", "changeme", "undefined", "str,", "String,"]),
                rng.choice(["${" + "_".join(words[:2]).upper() + "}", "$" + words[0].upper(), "<" + "-".join(words[:2]) + ">", "{{" + words[0] + "}}", "%s", "{}", "your_" + words[0], "YOUR_" + words[0].upper()]),
                rng.choice([f"{words[0]}.{words[1]}", f"{words[0]}.{words[1]}()", f"{words[0]}({words[1]})", f"{words[0]}[{words[1]}]", f"self.{words[0]},", f"os.environ[{words[0].upper()}]"]),
            )[kind - 5]
        out.append((value, before, path, int(kind < 5 and "test" not in path)))
    return out


def grow(x, y, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list:
    """A random forest: nested tuples ``(feature, threshold, left, right)`` with the share of positives as leaves."""
    import numpy as np

    rng = np.random.default_rng(seed)
    some = max(2, int(np.sqrt(x.shape[1]) + 0.5))

    def node(rows, left: int):
        p = float(y[rows].mean())
        if left == 0 or p in (0.0, 1.0) or len(rows) < 8:
            return round(p, 4)
        best = None
        for f in rng.choice(x.shape[1], some, replace=False):
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12))):
                low = v <= cut
                a, n = low.sum(), len(rows)
                if a in (0, n):
                    continue
                pa, pb = y[rows][low].mean(), y[rows][~low].mean()
                gini = a * pa * (1 - pa) + (n - a) * pb * (1 - pb)
                if best is None or gini < best[0]:
                    best = gini, int(f), float(cut), low
        if best is None:
            return round(p, 4)
        _, f, cut, low = best
        return f, cut, node(rows[low], left - 1), node(rows[~low], left - 1)

    return [node(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)] if len(y) else [0.5]


def tree_sql(tree, names: Sequence[str] = FEATURES) -> str:
    """One tree as an SQL expression over feature columns."""
    if isinstance(tree, float):
        return f"{tree}D"
    f, cut, a, b = tree
    return f"IF({names[f]} <= {cut!r}D, {tree_sql(a, names)}, {tree_sql(b, names)})"


def fit(spark: SparkSession, findings: DataFrame | None = None) -> list:
    """Grows a forest on labelled findings; the features come from the same expressions as the scan's."""
    import numpy as np

    if findings is None:
        findings = spark.createDataFrame(sample_findings(), "candidate string, before string, path string, label int, after string")
    known = findings.where("candidate is not null and label is not null").orderBy(F.xxhash64("candidate", "before", "path")).limit(MAX_FINDINGS)
    after = F.col("after") if "after" in findings.columns else F.lit("")
    rows = known.select(*[c.cast("double") for c in features(F.col("candidate"), F.col("before"), F.col("path"), after)], F.col("label").cast("double")).collect()
    data = np.array([tuple(r) for r in rows], float).reshape(len(rows), len(FEATURES) + 1)
    data = data[np.lexsort(data.T)]
    return grow(data[:, :-1], data[:, -1])


def marked(text: Column) -> Column:
    """The text with a copy of each assigned value before its place, between marks, and with a mark after each run of key characters that can hold a known form.

    A quoted value is only looked at, not passed over, so assignments inside it are found too; it ends at the next quote of its kind, so all of them together are
    read in linear time. A bare value ends before white space, before another assignment and at a separator that another name follows.
    """
    text = F.translate(text, OPEN + BARE + SHUT + CUT, LOST * 4)
    copied = F.regexp_replace(text, rf"(?i){NAME}\s*+{ASSIGN}\s*+(?=[^\s=:>])(?={VALUE})", f"$0{OPEN}$1$2{BARE}$3{SHUT}")
    return F.regexp_replace(F.when(text.rlike(NAMED), copied).otherwise(text), "([A-Za-z0-9+/_-]{13,}+={0,2})", f"$1{CUT}")


def forest_score(forest: list) -> Column:
    """The forest's mean vote over the feature columns.

    The nodes are constant arrays that are walked from each root, so the plan's code doesn't grow with the forest.
    """
    nodes, roots = [], []

    def add(tree) -> int:
        at = len(nodes)
        nodes.append([0, 0.0, at, at, tree])  # a leaf leads to itself
        if not isinstance(tree, float):
            f, cut, a, b = tree
            nodes[at] = [f, cut, add(a), add(b), 0.0]
        return at

    roots = [add(t) for t in forest]
    depth = lambda t: 1 if isinstance(t, float) else 1 + max(depth(t[2]), depth(t[3]))
    fixed = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
    feature, cut, low, high, share = (fixed(v, k) for v, k in zip(zip(*nodes), ("int", "double", "int", "int", "double")))

    def total(x: Column) -> Column:
        step = lambda n, _: F.when(F.get(x, F.get(feature, n)) <= F.get(cut, n), F.get(low, n)).otherwise(F.get(high, n))
        leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(max(map(depth, forest)))), root, step)
        return F.aggregate(fixed(roots, "int"), F.lit(0.0), lambda s, root: s + F.get(share, leaf(root)))

    return F.get(F.transform(F.array(F.array(*FEATURES)), total), F.lit(0)) / F.lit(float(len(forest)))


def scan(docs: DataFrame, forest: list, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """A row for each candidate: ``id_col, word, nth`` (its word and place in it), ``length, sha256, score, secret``."""
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), (F.col(path_col) if path_col else F.lit("")).cast("string").alias("p"))
    some = texts.where(F.col("t").rlike(r"[A-Za-z0-9+/_-]{16}") | F.col("t").rlike(KNOWN_INSIDE) | F.col("t").rlike(NAMED))
    split = some.select("d", "p", F.regexp_extract_all(marked(F.col("t")), F.lit(f"({WORD})"), F.lit(1)).alias("w"))
    bare = lambda w: F.regexp_replace(w, f"{OPEN}[^{SHUT}]*+{SHUT}", "")
    near = lambda i, k: bare(F.coalesce(F.get("w", i + k), F.lit("")))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).startswith(OPEN) | F.get("w", i).rlike("[0-9]") & F.get("w", i).rlike(KEY) | F.get("w", i).rlike(KNOWN_INSIDE))
    word = lambda i: F.struct(i.alias("word"), F.get("w", i).alias("whole"), F.concat_ws(" ", *[near(i, -k) for k in (3, 2, 1)]).alias("before"), F.concat_ws(" ", near(i, 1), near(i, 2)).alias("after"))
    found = split.select("d", "p", F.explode(F.when(F.size("w") > 0, F.transform(places, word))).alias("x")).select("d", "p", "x.*")
    found = found.select("d", "p", "word", "before", "after", bare(F.col("whole")).alias("own"), F.regexp_extract("whole", f"^{OPEN}([^{SHUT}]*+){SHUT}", 1).alias("copy"))
    value = F.translate(F.concat(F.substring_index("copy", BARE, 1), F.rtrim(F.substring_index("copy", BARE, -1), F.lit("\"',;)"))), CUT, "")
    runs = F.filter(F.regexp_extract_all("own", F.lit(f"({KEY})"), F.lit(1)), lambda c: c.rlike("[0-9]"))
    known = F.regexp_extract_all("own", F.lit(f"({KNOWN_INSIDE})"), F.lit(1))
    assigned = F.regexp_replace(value, r"\s++", " ")
    more = F.array_except(F.filter(F.concat(known, F.array(assigned)), lambda c: c != ""), runs)
    each = found.select("*", F.posexplode(F.concat(runs, more)).alias("nth", "candidate"))
    ready = each.select("d", "word", "nth", "candidate", "p", F.concat(F.col("before"), F.lit(" "), F.expr("CASE WHEN instr(own, candidate) > 0 THEN substring_index(own, candidate, 1) ELSE '' END")).alias("before"), "after")
    scored = ready.select("d", "word", "nth", "candidate", *[c.cast("double").alias(n) for n, c in zip(FEATURES, features(F.col("candidate"), F.col("before"), F.col("p"), F.col("after")))])
    out = scored.select(F.col("d").alias(id_col), "word", "nth", F.col("length").cast("long").alias("length"), F.sha2("candidate", 256).alias("sha256"), F.round(forest_score(forest), 6).alias("score"))
    return out.withColumn("secret", F.col("score") >= threshold)

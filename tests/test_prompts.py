"""The prompt composer: every drawn sentence against a plain reading of the space, and pairs of sentences."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import functions as F

from frameloom.functions.text import CLEANUP, clean_commas
from frameloom.operators import compose as co
from frameloom.operators.dealing import by_keys


def clean(text):
    for pattern, to in CLEANUP:
        text = re.sub(pattern, to, text)
    return text.strip(" ")


def draw(total, most, rank):
    return list(range(total)) if total <= most else [(rank % total + q * co.STEP) % total for q in range(most)]


def verbs(verb):
    third = verb + ("es" if re.search("(s|x|ch|sh)$", verb) else "s")
    return third, co.PARTICIPLES.get(verb) or verb + ("d" if verb.endswith("e") else "ed")


def realise(form, prefix, thing, infix, verb, suffix):
    said = lambda xs: [x for x in xs if x is not None]
    first, between, last = " ".join(x + "," for x in said(prefix)), " ".join(said(infix)), " ".join(said(suffix))
    many = " and " in thing
    third, done = verbs(verb)
    apart = f"{thing}, {between}," if between else thing
    parts = {"present": [first, apart, verb if many else third, last], "present_pass": [first, apart, ("are " if many else "is ") + done, last], "imperative": [first, verb, thing, between, last], "imperative_ccomp": [first, "make", thing, verb, between, last], "imperative_advcl": [first, "animate", thing, "to", verb, between, last]}[form]
    text = " ".join(p for p in parts if p)
    return clean(text[0].upper() + text[1:] + ".")


def space(unit, order, form):
    """Groups of one unit, order and form: the ordering and its sentences in the order of their numbers."""
    names, mods = [unit.sequence[i] for i in order], [unit.slots[i + 2] for i in order]
    groups = {}
    for i in range(len(names) + 1):
        for wide in (0, 1):
            if i + wide > len(names):
                continue
            between = names[i : i + wide]
            seq = names[:i] + (["object", *between, "verb"] if form.startswith("present") else (["verb", "object"] if form == "imperative" else ["object", "verb"]) + between) + names[i + wide :]
            look = next((n for n in ("direction", "direction_magnitude") if n in seq), None)
            if unit.type != "translate" and look and (seq.index(look) == 0 or seq[seq.index(look) - 1] not in ("object", "verb")):
                continue
            lists = [*unit.slots[:2], *mods]
            if wide:
                lists[i + 2] = [x for x in lists[i + 2] if x is not None]
            found = [(i, wide, n, realise(form, c[2 : i + 2], c[0], c[i + 2 : i + 2 + wide], c[1], c[i + 2 + wide :])) for n, c in enumerate(itertools.product(*lists))]
            groups.setdefault((i, wide if form.startswith("present") else None), (seq, []))[1].extend(found)
    return groups


def motions(spark):
    thing, other = ("square", "red"), ("circle", "blue")
    rows = [
        (1, "translate", 1.0, 0.0, 50.0, None, None, 2.0, None, [thing]), (2, "translate", 0.0, 1.0, None, 30.0, None, None, "left_of", [thing, other]),
        (3, "rotate", 1.0, None, 90.0, None, ["50%", "50%"], 1.0, None, [other]), (4, "scale", 1.0, 1.0, 2.0, 2.0, ["10", "20"], None, None, [thing]), (5, "scale", -1.0, 0.0, 0.5, None, None, 3.0, None, [thing]),
    ]
    pair = "array<struct<shape:string,fill:string>>"
    df = spark.createDataFrame(rows, f"id long, type string, x double, y double, size_x double, size_y double, origin array<string>, duration double, post string, agents {pair}")
    return df.withColumn("post_reference", F.array(F.struct(F.lit("box").alias("shape"), F.lit("gray").alias("fill"))))


def test_prompts_equal_the_listed_space(spark):
    """Every group's draws, rules, texts and duplicates, by listing all sentences."""
    units = co.units(motions(spark)).cache()
    orders, per_group = 3, 2
    got = {}
    for r in co.prompts(units, ["id"], F.col("id") * 13, orders=orders, per_group=per_group).collect():
        assert (r.id, r.sentence) not in got
        got[r.id, r.sentence] = (r.unit, r.order_no, r.form, tuple(r.ordering))
    perms = list(itertools.permutations(range(5)))
    rows, sizes = [], set()
    for u in units.collect():
        for no in draw(120, orders, u.id * 13) if u.unit == 0 else [0]:
            order = perms[no] if u.unit == 0 else range(len(u.sequence))
            for form in co.FORMS:
                for (i, _), (seq, sentences) in space(u, order, form).items():
                    sizes.add(len(sentences))
                    for r in draw(len(sentences), per_group, u.id * 13 * 31 + no * 7 + i):
                        at, wide, n, text = sentences[r]
                        rows.append((u.id, text, form, u.unit, no, at, wide, n, tuple(seq)))
    want = {}
    for r in sorted(rows, key=lambda r: r[2:8]):
        want.setdefault(r[:2], (r[3], r[4], r[2], r[8]))
    assert got == want and len(got) > 300 and max(sizes) > 8
    assert any("they" not in s and s.startswith("Animate the") for _, s in got) and any(" are moved" in s for _, s in got)
    said = {r.sentence for r in co.prompts(units.where("id = 2"), ["id"], F.col("id"), ("present",), 1, 1, F.lit("pron")).collect()}
    assert said and all(re.search(r"\bthey\b", s, re.I) and "red square and" not in s.replace("until", "") for s in said)


def test_all_sentences_without_sampling(spark):
    """With more draws than sentences the whole space comes out."""
    units = co.units(motions(spark)).where("id = 1 and unit = 0")
    got = {r.sentence for r in co.prompts(units, ["id"], F.lit(0), ("present_pass",), 120, 10**6).collect()}
    u = units.collect()[0]
    want = {s[3] for p in itertools.permutations(range(5)) for _, group in space(u, p, "present_pass").values() for s in group}
    assert got == want


def test_pairs_equal_the_listed_product(spark):
    sentences = [(g, f, f"{f} {i} {'of ' * i}it moves.") for g in range(4) for f in ("present", "imperative") for i in range(5 if g else 2)]
    first = spark.createDataFrame(sentences, "g int, form string, sentence string")
    second = spark.createDataFrame([(*s, {0: "before", 1: "after", 2: None, 3: "before"}[s[0]]) for s in sentences], "g int, form string, sentence string, relation string")
    ways = {"before": [("concat", "and then"), ("standalone", "then"), ("standalone", "next")], "after": [("concat", "after")], None: [("standalone", "")]}
    words = spark.createDataFrame([(k, *w) for k, ws in ways.items() if k for w in ws], "relation string, way string, connector string")
    rules = {"present": ["present"], "imperative": None}
    for most in (7, 10**6):
        got = sorted((r.g, r.first_form, r.second_form, r.way, r.sentence) for r in co.pair_prompts(first, second, words, ["g"], rules, most, F.col("g") * 5, 50).collect())
        want = {}
        for g in range(4):
            own = sorted((s, f) for k, f, s in sentences if k == g)
            relation = {0: "before", 1: "after", 2: None, 3: "before"}[g]
            product = [(a, b, w) for a in own for b in own for w in sorted(ways[relation])]
            for r in draw(len(product), most, g * 5):
                (a, fa), (b, fb), (way, word) = product[r]
                if way == "concat" and (fa, fb) != ("present", "present"):
                    continue
                low = b[0].lower() + b[1:]
                text = f"{a} {b}" if not word else f"{a} {word.capitalize()}, {low}" if way == "standalone" else f"{a.rstrip('.')}, {word} {low}"
                want.setdefault((g, clean(text)), (g, fa, fb, way, clean(text)))
        assert got == sorted(want.values())
    sampled = co.pair_prompts(first, second, words, ["g"], rules, 10**6, F.col("g"), 2)
    assert sampled.where("g = 2").count() == 4


def test_draws_dont_repeat_where_the_step_divides_the_product(spark):
    rows = spark.range(2).select(F.col("id"), F.array(F.transform(F.sequence(F.lit(1), F.lit(co.STEP)), lambda x: x.cast("string"))).alias("slots"))
    out = co.slot_product(rows, "slots", ["id"], 50).select("id", "choice_no", F.get("choice", F.lit(0)).cast("long").alias("said")).collect()
    assert len({(r.id, r.choice_no) for r in out}) == len(out) == 100 and all(r.said == r.choice_no + 1 for r in out)


def test_a_given_draw_decides_and_small_groups_stay_whole(spark):
    rows = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1), (None, 2)], "k string, v int")
    out = {(r.k, r.v) for r in co.down_sample(rows, ["k"], 3, ["v"], draw=-F.col("v")).collect()}
    assert out == {("a", 8), ("a", 7), ("a", 6), ("b", 1), (None, 2)}


def exchanges(df):
    """Shuffles of a plan, as lines."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_sentences_are_not_shuffled(spark):
    """A motion's units meet before they are said: one shuffle, of the units; the sentences and their pairs stay where they are."""
    said = co.prompts(co.units(motions(spark)), ["id"], F.col("id"), ("present", "imperative"), 1, 1)
    assert [("sentence" in line, "(id#" in line) for line in exchanges(said)] == [(False, True)]
    words = spark.createDataFrame([("before", "standalone", "then")], "relation string, way string, connector string")
    second = said.select("id", "form", "sentence", F.lit("before").alias("relation"))
    pairs = co.pair_prompts(second, second, words, ["id"], {"present": ["present"]}, 4, F.col("id"))
    assert len([line for line in exchanges(pairs) if "(id#" in line]) == 1
    once = {tuple(r) for r in pairs.collect()}
    assert once and once == {tuple(r) for r in co.pair_prompts(second.drop("relation"), second, words, ["id"], {"present": ["present"]}, 4, F.col("id")).collect()}


def test_tasks_grow_with_the_rows(spark):
    assert by_keys(spark.range(1000), ["id"], 3, most=100).rdd.getNumPartitions() == 30
    assert by_keys(spark.range(3), ["id"], 10**6, most=1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert by_keys(spark.range(1000), ["id"], 10, most=1).rdd.getNumPartitions() == 200


def test_clean_texts_are_recognised(spark):
    texts = ["".join(t) for n in range(6) for t in itertools.product("a ,.\t", repeat=n)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean_commas(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == {t: clean(t) for t in texts}

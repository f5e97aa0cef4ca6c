"""SimHash groups, line deduplication and components against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from frameloom.llm import line_dedup, simhash
from frameloom.llm.common import components


def union(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union({x for e in edges for x in e}, edges)
    lone = {a for a, b in edges if a == b} - set(got)
    assert {**{n: n for n in lone}, **got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_links_are_whole(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(12)} | {0, 1, 3, 7, 15}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for limit in (3, 1):
        got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), limit).collect()}
        want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= limit}
        assert got == want


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(120)] for _ in range(6)]
    texts = [None, "", " \n", "One two", "one TWO", "É x"] + [" ".join(w if rng.random() > 0.01 else "zz" for w in b) for b in bases for _ in range(5)]
    rows = [(i + 10, t) for i, t in enumerate(texts)] + [(10, None), (99, texts[8]), (None, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = union(set(range(len(rows))), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[groups[i]] = min(key, least.get(groups[i], key))
    want = sorted((key or 0, f"{prints[i]:016x}", least[groups[i]]) for i, (key, _) in enumerate(rows))
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(groups.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rng, text, n, letters="abé"):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out) + 1)
        how = rng.randrange(3)
        if how == 0:
            out.insert(k, rng.choice(letters))
        elif out and how == 1:
            out.pop(min(k, len(out) - 1))
        elif out:
            out[min(k, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_distance(spark, edits):
    rng = random.Random(4)
    pairs = [(a, edited(rng, a, rng.randint(0, 4))) for a in ("".join(rng.choice("abé") for _ in range(rng.randint(0, 40))) for _ in range(300))]
    df = spark.createDataFrame(pairs, "a string, b string")
    symbols = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    for r in df.select("a", "b", line_dedup.distance_within(symbols("a"), symbols("b"), edits).alias("d")).collect():
        d = lev(r.a, r.b)
        assert r.d == (d if d <= edits else None)
    for words in (False, True):
        cut = lambda x: x.replace("b", " ").split(" ") if words else x
        a, b = (F.replace(F.col(c), F.lit("b"), F.lit(" " if words else "b")) for c in ("a", "b"))
        got = df.where(line_dedup.within(a, b, edits, words)).collect()
        assert sorted((r.a, r.b) for r in got) == sorted(p for p in pairs if lev(*map(cut, p)) <= edits)


def is_near(a, b, per_edit, most):
    n = max(len(a.split(" ")), len(b.split(" ")))
    return n < 2 * per_edit and lev(a, b) <= 1 or n >= per_edit and lev(a.split(" "), b.split(" ")) <= min(most, n // per_edit)


def brute_lines(rows, per_edit, most, least):
    """Dropped (exact, near) positions of each row, and for each row the ids of documents with an earlier near line by position."""
    seen, first, holders = {}, {}, {}
    names = [r.h for r in line_hashes([t for _, t in rows])]
    for (key, text), h in zip(rows, names):
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            if line.strip(" "):
                at = (key is not None, key or 0, h, pos)
                seen[key, text, pos] = line, at
                if line not in first or at < first[line]:
                    first[line], holders[line] = at, key
    long_ = [x for x in first if len(x) >= least]
    near = {b: {holders[a] for a in long_ if a != b and first[a] < first[b] and is_near(a, b, per_edit, most)} for b in long_}
    out = {}
    for (key, text, pos), (line, at) in seen.items():
        if first[line] != at:
            out.setdefault((key, text), ({}, {}))[0][pos] = None
        elif near.get(line):
            out.setdefault((key, text), ({}, {}))[1][pos] = near[line]
    return out


def line_hashes(texts):
    """The order of rows with one id: 31 bits of the text's hash."""
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return df.select("i", (F.xxhash64("t").bitwiseAND(F.lit((1 << 31) - 1))).alias("h")).orderBy("i").collect()


def check_lines(docs, rows, per_edit, most, least):
    want = brute_lines(rows, per_edit, most, least)
    key = lambda k: (k is not None, k or 0)
    got = sorted(((key(r.doc_id), r.n_lines, tuple(r.exact), tuple(r.near), tuple(r.near_of), r.n_kept) for r in line_dedup.line_report(docs, per_edit=per_edit, most=most, least=least).collect()), key=lambda x: x[:4])
    expected = []
    for k, text in rows:
        exact, near = want.get((k, text), ({}, {}))
        n = 0 if text is None else text.count("\n") + 1
        expected.append((key(k), n, tuple(sorted(exact)), tuple(sorted(near)), [near[p] for p in sorted(near)], n - len(exact) - len(near)))
    expected.sort(key=lambda x: x[:4])
    assert [(*g[:4], g[5]) for g in got] == [(*e[:4], e[5]) for e in expected]
    assert all(x in may for g, e in zip(got, expected) for x, may in zip(g[4], e[4]))
    out = line_dedup.dedup_lines(docs, per_edit=per_edit, most=most, least=least)
    assert out.columns == docs.columns
    texts = []
    for k, text in rows:
        gone = set().union(*want.get((k, text), ({}, {})))
        texts.append((key(k), None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)))
    assert sorted(((key(r.doc_id), r.text) for r in out.collect()), key=repr) == sorted(texts, key=repr)
    return want


@pytest.mark.parametrize("per_edit,most", [(4, 1), (3, 2), (3, 3)])
def test_line_dedup(spark, per_edit, most):
    rng = random.Random(per_edit + 7 * most)
    words = lambda n: [rng.choice(["a", "bé", "c", "dd", "xyz"]) for _ in range(n)]
    lines = [words(rng.randint(2, 16)) for _ in range(30)]
    pool = [" ".join(x) for x in lines] + ["", "x", " " * 12, "  a", "a  b c d e f g h"]
    for _ in range(60):
        x = list(rng.choice(lines))
        for _ in range(rng.randint(1, 4)):
            k, how = rng.randrange(len(x) + 1), rng.randrange(3)
            x[k : k + (how > 0)] = [] if how == 1 else [rng.choice(["a", "q"])]
        pool += [" ".join(x), edited(rng, " ".join(x), rng.randint(1, 2))]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(50)]
    rows += [(60, None), (61, ""), (None, pool[0]), (3, "other\n" + pool[1] + "!"), (3, "other\n" + pool[2]), (3, pool[3] + "\nother")]
    rows.append(rows[5])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("t", F.lit(1)).withColumn("h1", F.lit(2)).withColumn("id", F.lit(3)).repartition(3)
    want = check_lines(docs, rows, per_edit, most, 10)
    assert sum(len(x[1]) for x in want.values()) > 15
    assert line_dedup.line_report(docs.limit(0)).count() == 0 and line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_large_groups(spark):
    """500 copies within one edit of a line at every place, a very long line, string ids, and tables that join in a shuffle."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(50)}" for _ in range(24)]
    rows = [(i, " ".join(base[:k] + [f"n{i}"] + base[k + 1 :]) + "\nshort") for i in range(500) for k in [i % 6 * 4]]
    long_ = " ".join(f"w{rng.randrange(9999)}" for _ in range(30_000))
    rows += [(600, long_), (601, long_.replace(" ", "  ", 1)), (602, long_ + " end"), (603, long_[:-300])]
    kept = {r.doc_id: r for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = [(i, t.split("\n")[0].split()) for i, t in rows[:500]]
    for i, w in words:
        near = any(sum(x != y for x, y in zip(w, v)) <= 1 for j, v in words if j < i)
        assert kept[i].near == ([0] if near else []) and kept[i].exact == ([1] if i else [])
    assert [kept[i].near for i in (600, 601, 602, 603)] == [[], [0], [0], []]
    held = line_dedup.BROADCAST_ROWS
    line_dedup.BROADCAST_ROWS = 0
    try:
        named = line_dedup.line_report(spark.createDataFrame([(f"{i:04d}", t) for i, t in rows], "doc_id string, text string")).collect()
    finally:
        line_dedup.BROADCAST_ROWS = held
    assert {int(r.doc_id): (r.exact, r.near) for r in named} == {i: (r.exact, r.near) for i, r in kept.items()}


@pytest.mark.parametrize("per_edit,most,small", [(4, 1, 1), (3, 3, 3)])
def test_hot_keys_are_divided(spark, monkeypatch, per_edit, most, small):
    """Lines with common beginnings, ends and middles, which differ in a few words, in very short remainders, or in characters of one word."""
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "LEVELS", 4)
    rng = random.Random(per_edit + most)
    some = lambda: rng.choice(["a", "bé", "c", "dd", "xyz", "q1", "r22"])
    pool = []
    for k in range(70):
        fixed = ["log", "at", "host", "seven", "says"]
        pool += [" ".join((fixed + [some(), some(), some()], [some(), some()] + fixed + [some()], [some()] + fixed[:3] + [some()] + fixed[3:], fixed + [some()] * rng.randint(0, 3))[k % 4])]
        pool += ["https://example.org/p/" + "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(4))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = check_lines(docs, rows, per_edit, most, 10)
    assert sum(len(x[1]) for x in want.values()) > 15


def test_many_lines_that_share_half(spark):
    """A key with 4,000 lines of which each but a few is near to none, and its copies with one word changed."""
    rng = random.Random(4)
    head = "a common beginning of ten words that all lines share"
    lines = [head + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(10)) for _ in range(4000)]
    late = {4000 + i: lines[i * 700].rsplit(" ", 1)[0] + f" other{i}" for i in range(5)}
    docs = spark.createDataFrame([*enumerate(lines), *late.items()], "doc_id int, text string")
    got = {r.doc_id: r.near_of for r in line_dedup.line_report(docs).where("size(near) > 0").collect()}
    assert got == {4000 + i: [i * 700] for i in range(5)}

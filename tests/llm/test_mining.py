"""Vector codes, mixing and collocations against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import collocations, mixing, vector_codes

# vector codes


def brute_codes(rows):
    """Rows of (id, vector, label) by plain integers."""
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    w = width // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[cut(v, p) for _, v, _ in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def best(x, book):
        d = [far(x, c) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(4):
        for p in range(4):
            got = defaultdict(list)
            for _, v, _ in kept:
                got[best(cut(v, p), books[p])[0]].append(cut(v, p))
            for e, xs in got.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        found = [best(cut(v, p), books[p]) for p in range(4)]
        out.append((i, "".join(f"{c:02x}" for c, _ in found), sum(d for _, d in found), lab))
    sums = defaultdict(int)
    for _, _, e, lab in out:
        sums[lab] += e
    return sorted(((i, c, e, sums[lab], sha) for i, c, e, lab in out), key=repr)


def run_codes(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash")).repartition(3)
    return sorted(map(tuple, vector_codes.compress(df, **more).collect()), key=repr)


def test_codes_equal_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.gauss(0, 0.02) for _ in range(8)] for _ in range(40)]
    rows = [(i, [x + rng.choice([0, 0, 1 / 1024, -1 / 1024, rng.gauss(0, 0.01)]) for x in rng.choice(base)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += rows[:5] + [(None, base[0], 1), (None, None, 1), (900, [None] * 8, 1), (901, [math.nan] * 8, 1), (902, [math.inf] + [0.0] * 7, None), (903, [0.5, 0.5], 2), (904, [], None)]
    assert run_codes(spark, rows) == brute_codes(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, [], 1), (2, [], None)], [(3, [1.0, -0.5, 2.0, 3.25], None)] * 4, [(1, [3e9, -3e9, 1e6, 1.5], 1), (2, [3e9, -3e9, 1e6, 2.5], 1)]])
def test_codes_of_small_tables(spark, rows):
    assert run_codes(spark, rows) == brute_codes(rows)


def test_codes_beyond_long_are_null(spark):
    rows = [(i, [0.0] * 4, 1) for i in range(256)] + [(300, [4e15, 0.0, 0.0, 0.0], 1), (301, [-4e15, 0.0, 0.0, 0.0], 2), (302, [0.5] * 4, 2)]
    got = {r[0]: r for r in run_codes(spark, rows, rounds=0)}
    assert got[300][2] is None and got[300][3] is None and got[0][2] == 0 and got[301][3] is None


@pytest.mark.parametrize("scale", [3, 1000, 10**6, 2**27])
def test_screening_keeps_the_nearest(scale):
    """Dense ties and near ties: entries that float32 can't tell apart."""
    rng = np.random.default_rng(scale)
    entries = rng.integers(-scale, scale + 1, (64, 4))
    entries = np.concatenate([entries, entries[:20], entries[:20] + rng.integers(-1, 2, (20, 4))])
    parts = np.concatenate([rng.integers(-scale, scale + 1, (3000, 4)), entries + 1])
    d = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    codes, errors = vector_codes.nearest(parts, entries)
    assert (codes == d.argmin(1)).all() and (errors == d.min(1)).all()
    wide = vector_codes._nearest_wide(parts[:50], entries)
    assert (wide[0] == d.argmin(1)[:50]).all()


def test_decoded_vectors_lie_at_the_error(spark):
    rows = [(i, [(i * k % 17) / 16 for k in range(1, 9)], 0) for i in range(300)]
    kept, width = vector_codes.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    books = vector_codes.train(kept, width)
    out = vector_codes.decode(vector_codes.encode(kept, books, width), books).collect()
    own = {i: v for i, v, _ in rows}
    assert len(out) == 300 and all(round(sum((a - b) ** 2 for a, b in zip(own[r.id], r.vector)) * 1024**2) == r.error for r in out)


# mixing


def brute_targets(sizes: dict):
    """Targets by rounds over sources in code point order, null last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = Fraction(sum(sizes.values())), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * sizes[s] <= unit * weight[s]}
        for s in full:
            out[s] = Fraction(3 * sizes[s])
        free -= full
        left -= sum(3 * sizes[s] for s in full)
        if not full:
            out |= {s: unit * weight[s] for s in free}
            break
    return out


def run_mix(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1)).repartition(5)
    return mixing.mix(df, **more).collect()


def corpus(seed: int, n: int = 600):
    rng = random.Random(seed)
    sources = ["a", "B", "é", None, "z", "tiny", "\U0001f600", "￮"]
    rows = []
    for i in range(n):
        s = "a" if rng.random() < 0.35 else rng.choice(sources)
        if s == "tiny" and rng.random() < 0.9:
            s = "B"
        rows.append((i, rng.choice(["x ", "yy\t", "word\n", " n "]) * int(rng.paretovariate(1.1)), s))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_targets(spark, seed):
    rows = corpus(seed) + [(None, None, "a"), (None, "", None), (7, "again " * 5, "z"), (7, "again " * 5, "z"), (None, "only", "lonely"), (None, None, "void")]
    words = {}
    for i, t, _ in rows:
        words[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for _, t, s in rows:
        by[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    aims = brute_targets(by)
    assert sum(aims.values()) == sum(by.values()) and aims["void"] == 0
    out = run_mix(spark, rows)
    assert len(out) == len(rows)
    source_of = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for i, t, s in rows if i is not None}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        if r.doc_id is not None:
            s = source_of[r.doc_id, r.size]
            assert r.source_size == by[s] and r.target == pytest.approx(float(aims[s]), rel=1e-12)
            epochs = int(aims[s] // by[s]) if by[s] else 0
            assert r.taken in (epochs * r.size, (epochs + 1) * r.size)  # whole epochs first
            taken[s] += r.taken
            largest[s] = max(largest[s], r.size)
    for s in ("B", "z", "tiny", "é"):
        assert abs(taken[s] - float(aims[s])) <= largest[s] / 2 + 5
    key = lambda rs: sorted(map(tuple, rs), key=repr)
    assert key(run_mix(spark, rows[::-1])) == key(out)


def test_mix_prefers_heavier_documents(spark):
    rows = [(i, "w " * 10, "s") for i in range(1500)] + [(9999, "w " * 40_000, "t"), (10000, "x", "u")]
    out = {r.doc_id: r for r in run_mix(spark, rows, weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))}
    again = [i for i in range(1500) if out[i].taken > out[i].size * (out[i].target // out[i].source_size)]
    assert 0 < len(again) < 1500 or out[0].target == 3 * out[0].source_size
    if len(again) < 1500 and again:
        assert sum(i % 2 == 0 for i in again) > 0.6 * len(again)


def test_mix_order_is_that_of_keys(spark):
    """What the rest of a source takes are the least keys: brute force over the drawn keys."""
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    text = F.col("text")
    keys = {r.doc_id: r.k for r in df.select("doc_id", (-F.ln(mixing.uniform(F.col("doc_id"), text)) / mixing.quality(text)).alias("k")).collect()}
    out = {r.doc_id: r for r in run_mix(spark, rows)}
    for s in {s for _, _, s in rows}:
        own = sorted((i for i, _, t in rows if t == s), key=keys.__getitem__)
        at, first = 0, out[own[0]]
        epochs = first.target // first.source_size
        for i in own:
            r = out[i]
            assert r.taken == r.size * (epochs + (at + r.size / 2 <= r.target - epochs * r.source_size))
            at += r.size


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "one two", None)], [(1, "", "a"), (2, "b", "a")]])
def test_mix_of_small_tables(spark, rows):
    out = run_mix(spark, rows)
    assert len(out) == len(rows) and sum(r.taken for r in out) == sum(r.size for r in out)


# collocations


def brute_phrases(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(w[i : i + m] for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        found = {}
        for w, a in c.items():
            if len(w) > 1 and a >= least:
                cuts = [(2_000_000 * a // (c[w[:k]] + c[w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                found[w] = (score, a, c[w[:k]], c[w[k:]])
        inner = {}
        for w in found:
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    inner[w[i : i + m]] = max(inner.get(w[i : i + m], 0), c[w])
        left = [(-s, -a, " ".join(w).encode(), left_, right) for w, (s, a, left_, right) in found.items() if 100 * inner.get(w, 0) < 80 * a]
        out += [(lang, i + 1, p.decode(), -a, left_, right, n[lang], -s) for i, (s, a, p, left_, right) in enumerate(sorted(left)[:top])]
    return sorted(out)


def run_phrases(spark, rows, **more):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, text string, doc_id long").withColumn("phrase", F.lit("clash")).repartition(4)
    return df, sorted(map(tuple, collocations.collocations(df, **more).collect()))


def prose(seed: int, n: int = 300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "New", "york", "city", "Été", "été", "x" * 60, "x" * 59 + "y", "z\x01", "z"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(60)):
            text += rng.choice([rng.choice(words), "new york city hall", "in the end of", f"w{int(rng.paretovariate(0.7))}"]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!", "\x0b"])
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return [*rows, ("en", None), (None, ""), ("xx", " .,"), *rows[:20]]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(spark, seed):
    rows = prose(seed)
    assert run_phrases(spark, rows)[1] == brute_phrases(rows)


@pytest.mark.parametrize("range_bytes,block", [(300, 1 << 20), (2000, 97), (40, 13)])
def test_ranges_and_blocks_change_nothing(spark, monkeypatch, range_bytes, block):
    """Bounds within the runs of frequent words, blocks within texts."""
    rows = prose(3, 120)
    df, _ = run_phrases(spark, rows[:1])
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    nodes = collocations.phrases(df, least=5, range_bytes=range_bytes, block=block).cache()
    whole = collocations.phrases(df, least=5, range_bytes=1 << 40).cache()
    key = lambda x: sorted((r.lang, r.m, r.phrase, r.suffix, tuple(r.lefts), r.own) for r in x.where("m > 0").collect())
    assert key(nodes) == key(whole) and len(key(whole)) > 100
    sums = lambda x: {r[0]: r[1] for r in x.where("m = 0").groupBy("lang").sum("own").collect() if r[1]}
    assert sums(nodes) == sums(whole)


def test_tries_of_chunks():
    text = (b"alpha beta gamma, delta " * 200 + b"epsilon\tzeta ") * 3
    whole = [w for part, _ in collocations.stretches(text, 1 << 20) for w in part]
    cut = [w for part, _ in collocations.stretches(text, 7, 50) for w in part]
    assert whole == cut == collocations.tokens(text)


def test_top_is_whole_with_ties(spark):
    rows = [("en", " ".join(f"p{i} q{i}." for i in range(150)))] * 30
    assert run_phrases(spark, rows, top=40)[1] == brute_phrases(rows, top=40)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("en", "one two three")]])
def test_collocations_of_small_tables(spark, rows):
    assert run_phrases(spark, rows)[1] == []


# the registered queries against their statements


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_mixing", "op13_collocations"])
def test_queries_equal_statements(spark, name):
    import os

    import oracle

    from frameloom.llm.registry import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    assert oracle.differences(QUERIES[name](spark, sf), oracle.connect(sf), ORACLE_SQL[name]) == ""

"""Interval sets and relations without pairs, against brute force; running sums and numbers."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from frameloom.functions.allen import INVERSE, RELATIONS
from frameloom.operators import intervals as iv
from frameloom.operators.ordinal import numbered, running_sum


def close(a, b):
    return abs(a - b) <= 5 + 1e-5 * abs(b)


def holds(name, a, b, gap):
    if name in INVERSE:
        return holds(INVERSE[name], b, a, gap)
    (s, e), (u, v) = a, b
    return {
        "precedes": e + gap < u, "meets": close(e, u), "overlaps": s < u < e < v, "finished_by": s < u and close(e, v), "contains": s < u and v < e, "starts": close(s, u) and e < v, "equals": close(s, u) and close(e, v),
    }[name]


def group(rng, n, wide, numbers):
    out = []
    for _ in range(n):
        s = numbers(rng.uniform(-wide, wide))
        out.append((s, s + numbers(rng.choice([0, 1, 5, 6, rng.uniform(0, wide / 2)]))))
    return out


@pytest.mark.parametrize("seed,numbers,gap", [(1, int, 1), (2, float, 0), (3, int, 0)])
def test_relations_equal_all_pairs(spark, seed, numbers, gap):
    rng = random.Random(seed)
    a, b, want = [], [], set()
    for k in range(160):
        wide = rng.choice([3, 12, 40, 300, 2_000_000])
        left, right = (group(rng, rng.randrange(6), wide, numbers) for _ in range(2))
        if right and left and rng.random() < 0.5:  # ends that lie at the tolerance's border
            s, e = rng.choice(right)
            left.append((s - 5, e + rng.choice([-5, 0, 5])) if s - 5 <= e - 5 else (s, e))
        a += [(k, *map(float, x)) for x in left]
        b += [(k, *map(float, x)) for x in right]
        want |= {(k, n) for n in RELATIONS if any(holds(n, x, y, gap) for x in left for y in right)}
    a, b = (spark.createDataFrame(x, "g int, s double, e double") for x in (a + a[:9], b))
    for few in (0, iv.FEW):
        got = {tuple(r) for r in iv.related(a, b, ["g"], gap=gap, few=few).collect()}
        assert got == want
    assert {n for _, n in want} == set(RELATIONS)
    some = ("overlaps", "finishes", "precedes")
    assert {tuple(r) for r in iv.related(a, b, ["g"], some, gap, 0).collect()} == {(k, n) for k, n in want if n in some}


def test_relations_of_many_runs(spark):
    """One group of 10,000 intervals a side: no pair of them in a plan, and time that grows with the rows."""
    rng = random.Random(5)
    took = []
    for n in (10_000, 40_000):
        sides = []
        for shift in (0, 7):
            at, rows = shift, []
            for _ in range(n):
                at += rng.randrange(20, 60)
                rows.append((1, at, at + rng.randrange(10)))
            sides.append(spark.createDataFrame(rows, "g int, s int, e int"))
        began = time.perf_counter()
        found = {r.relation for r in iv.related(*sides, ["g"], gap=1).collect()}
        took.append(time.perf_counter() - began)
        assert {"precedes", "preceded_by", "meets", "equals"} <= found
    assert took[1] < 4 * took[0] + 5


def test_empty_sides(spark):
    a = spark.createDataFrame([(1, 0, 3)], "g int, s int, e int")
    assert iv.related(a, a.limit(0), ["g"]).count() == 0 and iv.related(a.limit(0), a, ["g"]).count() == 0


def test_set_algebra(spark):
    rng = random.Random(7)
    rows = {n: [] for n in "abcu"}
    cells = {n: set() for n in "abcu"}
    for k in range(40):
        for n in "abcu":
            inside = {f for f in range(60) if rng.random() < (0.95 if n == "u" else 0.6)} if rng.random() < 0.9 else set()
            cells[n] |= {(k, f) for f in inside}
            at = 0
            while at < 60:
                if at in inside:
                    end = at
                    while end + 1 in inside:
                        end += 1
                    rows[n].append((k, at, end))
                    at = end
                at += 1
    t = {n: spark.createDataFrame(x, "k int, s int, e int") for n, x in rows.items()}

    def covers(df):
        got = df.collect()
        spans = sorted((r.k, r.s, r.e) for r in got)
        assert all(x[0] != y[0] or x[2] + 1 < y[1] for x, y in zip(spans, spans[1:]))  # maximal and apart
        return {(k, f) for k, s, e in spans for f in range(s, e + 1)}

    sets = {n: t[n] for n in "abc"}
    assert covers(iv.combined(sets, t["u"], ["k"], lambda f: f["a"] & ~f["b"] | f["c"])) == (cells["a"] - cells["b"] | cells["c"]) & cells["u"]
    assert covers(iv.union(t["a"], t["b"], ["k"])) == cells["a"] | cells["b"]
    assert covers(iv.intersection(t["a"], t["b"], ["k"])) == cells["a"] & cells["b"]
    assert covers(iv.complement(t["a"], t["u"], ["k"])) == cells["u"] - cells["a"]
    assert iv.combined(sets, t["u"].limit(0), ["k"], lambda f: f["a"]).count() == 0


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.randrange(50), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at int, id int, v int")
    got = {r.id: r.total for r in running_sum(df, [F.col("at"), F.col("id")], F.col("v"), "total", ["k"], 7).collect()}
    for k in ("x", "y", None):
        total = 0
        for _, _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            assert got[i] == total
            total += v
    got = {r.id: r.n for r in numbered(df, [F.col("at").desc(), F.col("id")], "n").collect()}
    assert [got[r[2]] for r in sorted(rows, key=lambda r: (-r[1], r[2]))] == list(range(3000))
    assert numbered(df.limit(0), [F.col("id")], "n").count() == 0

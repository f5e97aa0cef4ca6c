"""Exact frame runs of a stream, with late and repeated rows, against a plain reading batch by batch."""

from __future__ import annotations

import os
import random

from frameloom.streaming.runs import absorbed, close_runs, write_runs


def simulate(batches, lateness):
    open_, top, runs, late = {}, {}, [], []
    for rows in batches:
        bound = {k: t - lateness for k, t in top.items()}
        for k in {k for k, f in rows if f is not None}:
            mine = [f for kk, f in rows if kk == k and f is not None]
            late += [(k, f, f) for f in mine if k in bound and f < bound[k]]
            frames = {f for s, e in open_.get(k, []) for f in range(s, e + 1)} | {f for f in mine if k not in bound or f >= bound[k]}
            top[k] = max([*mine, top.get(k, mine[0])])
            own = []
            for f in sorted(frames):
                if own and own[-1][1] + 1 == f:
                    own[-1] = own[-1][0], f
                else:
                    own.append((f, f))
            runs += [(k, *r) for r in own if r[1] + 1 < top[k] - lateness]
            open_[k] = [r for r in own if r[1] + 1 >= top[k] - lateness]
    return sorted(runs), sorted(late)


def test_stream_closes_runs_and_keeps_late_rows(spark, tmp_path):
    rng = random.Random(11)
    batches = []
    for n in range(6):
        rows = [(k, f) for k in ("a", "b") for f in range(20 * n, 20 * n + 20) if rng.random() < 0.8]
        rows += [(rng.choice("ab"), max(0, 20 * n - rng.randrange(30))) for _ in range(8)] + [("a", None), ("b", 20 * n + 3), ("b", 20 * n + 3)]
        rng.shuffle(rows)
        batches.append(rows)
    batches.append([("a", 10_000), ("b", 10_000)])
    source = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, frame int").coalesce(1).write.mode("append").parquet(f"file://{source}")
        for f in source.glob("*.parquet"):
            if not f.name.startswith("done"):
                target = source / f"done-{n}.parquet"
                f.rename(target)
                os.utime(target, (1_600_000_000 + n, 1_600_000_000 + n))
    for f in source.iterdir():
        if f.suffix != ".parquet":
            f.unlink()
    stream = spark.readStream.schema("k string, frame int").option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    out = tmp_path / "out"
    write_runs(close_runs(stream, ["k"], lateness=5), f"file://{out}", f"file://{tmp_path}/checkpoint").awaitTermination(300)
    got = [sorted((r.k, r.s, r.e) for r in spark.read.parquet(f"file://{out}/{name}").collect()) for name in ("runs", "late")]
    want = simulate(batches, 5)
    assert got[0] == want[0] and got[1] == want[1] and len(got[1]) > 5
    # no row is lost: every frame is in a run or late
    covered = {(k, f) for k, s, e in got[0] + got[1] for f in range(s, e + 1)}
    assert {(k, f) for rows in batches[:-1] for k, f in rows if f is not None} <= covered


def test_table_form_and_edges(spark):
    rows = [("a", 1), ("a", 2), ("a", 2), ("a", 5), (None, 3), ("b", None)]
    df = spark.createDataFrame(rows, "k string, frame int")
    assert sorted(map(tuple, close_runs(df, ["k"]).collect()), key=repr) == sorted([("a", "run", 1, 2), ("a", "run", 5, 5), (None, "run", 3, 3)], key=repr)
    assert close_runs(df.limit(0), ["k"]).count() == 0
    assert absorbed([(1, 3), (7, 9)], [4, 6, 5, 20]) == [(1, 9), (20, 20)]

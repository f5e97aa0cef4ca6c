"""Run extraction on event streams: sessions in time, and exact frame runs with late rows as output of their own."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from frameloom.operators.runs import runs


def stream_runs(events: DataFrame, keys: list[str], time: str = "ts", gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``keys, s, e, n``: bursts of events with gaps under ``gap``. Works on a stream (append mode) and on a table."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    grouped = held.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n")


def absorbed(open_runs: list[tuple[int, int]], frames: list[int]) -> list[tuple[int, int]]:
    """Open runs with further frames, as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted([*open_runs, *((f, f) for f in frames)]):
        if out and s <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def close_runs(events: DataFrame, keys: list[str], frame: str = "frame", lateness: int = 0) -> DataFrame:
    """``keys, kind, s, e``: the runs of consecutive frames of each key (kind ``run``), and the frames that came too late (kind ``late``, ``s`` = ``e``).

    On a stream (append mode) a key keeps its greatest frame so far and its open runs. At a batch's end, frames more than ``lateness`` before the greatest are closed: runs that no open frame can lengthen go out
    and are forgotten, so a key's state is bounded by ``lateness``. A row of a later batch with a closed frame goes out as late, also where a run has that frame already; it changes no run. Frames that come again in time count once;
    a null frame is dropped. Runs that are open when a stream ends stay in its state. A table has no late rows, and all its runs are closed.
    """
    rows = events.select(*keys, F.col(frame).cast("bigint").alias("frame")).where("frame is not null")
    if not events.isStreaming:
        return runs(rows.distinct(), keys).select(*keys, F.lit("run").alias("kind"), "s", "e")
    import pandas as pd

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    names = [*keys, "kind", "s", "e"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        starts, ends, top = state.get if state.exists else ([], [], None)
        bound = None if top is None else top - lateness
        late: list[int] = []
        held = list(zip(starts, ends))
        for batch in batches:
            frames = batch["frame"].tolist()
            late += [f for f in frames if bound is not None and f < bound]
            held = absorbed(held, [f for f in frames if bound is None or f >= bound])
            top = max([*frames, *([] if top is None else [top])])
        done = [r for r in held if r[1] + 1 < top - lateness]
        held = held[len(done) :]
        state.update(([s for s, _ in held], [e for _, e in held], top))
        out = [(*key, "run", s, e) for s, e in done] + [(*key, "late", f, f) for f in sorted(late)]
        yield pd.DataFrame(out, columns=names).astype({"s": "int64", "e": "int64"})

    return rows.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, kind string, s bigint, e bigint", "s array<bigint>, e array<bigint>, top bigint", "append", "NoTimeout")


def write_runs(closed: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream that writes ``<path>/runs`` and ``<path>/late``, a folder for each batch, which a repeated batch replaces."""

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, name in (("run", "runs"), ("late", "late")):
            batch.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return closed.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

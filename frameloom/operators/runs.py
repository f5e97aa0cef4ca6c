"""Runs: closed frame intervals in which a condition holds, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(frames: DataFrame, keys: list[str], frame: str = "frame", where: Column | None = None) -> DataFrame:
    """``keys, s, e``: the maximal runs of consecutive frames in which ``where`` holds. One shuffle on the keys."""
    held = (frames if where is None else frames.where(F.coalesce(where, F.lit(False)))).select(*keys, F.col(frame).alias("f"))
    island = F.col("f") - F.row_number().over(Window.partitionBy(*keys).orderBy("f"))
    return held.withColumn("g", island).groupBy(*keys, "g").agg(F.min("f").alias("s"), F.max("f").alias("e")).drop("g")


def first_runs(found: DataFrame, keys: list[str]) -> DataFrame:
    """The first run of each key."""
    return found.groupBy(*keys).agg(F.min(F.struct("s", "e")).alias("r")).select(*keys, "r.s", "r.e")


def covered(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, frame``: the distinct frames that closed intervals cover; empty intervals cover none."""
    return intervals.where("s <= e").select(*keys, F.explode(F.sequence(F.col("s").cast("int"), F.col("e").cast("int"))).alias("frame")).distinct()


def merged(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, s, e``: the runs of the frames that closed intervals cover, without listing the frames: an interval that begins after all earlier ones' end plus one opens a run. One shuffle."""
    before = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("s") > F.max("e").over(before) + 1, F.lit(True))
    rows = intervals.where("s <= e").select(*keys, "s", "e").withColumn("fresh", fresh.cast("int")).withColumn("g", F.sum("fresh").over(upto))
    return rows.groupBy(*keys, "g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("g")


def with_flag(frames: DataFrame, marked: DataFrame, on: list[str], flag: str) -> DataFrame:
    """``frames`` with a boolean column that says whether the row is in ``marked``."""
    return frames.join(marked.select(*on).distinct().withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


#: What :func:`stretches` keeps of frames.
STATE = ("types", "dir_tx", "dir_ty", "dir_rot", "dir_sx", "dir_sy")


def stretches(frames: DataFrame, keys: tuple[str, ...] = ("scene_id", "obj_idx")) -> DataFrame:
    """``keys, s, e`` and the state of each stretch of frames (before ``steps``) in which an object's types and directions stay the same. One shuffle on the keys."""
    state = F.struct(*STATE)
    at = Window.partitionBy(*keys).orderBy("frame")
    fresh = F.lag("frame").over(at).isNull() | (F.lag("frame").over(at) + 1 != F.col("frame")) | ~F.lag(state).over(at).eqNullSafe(state)
    rows = frames.where("frame < steps").select(*keys, "frame", *STATE, fresh.cast("int").alias("fresh"))
    rows = rows.withColumn("g", F.sum("fresh").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "g").agg(F.min("frame").cast("bigint").alias("s"), F.max("frame").cast("bigint").alias("e"), *[F.first(c).alias(c) for c in STATE]).drop("g")

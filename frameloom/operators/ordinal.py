"""Running sums and row numbers over a total order, without a window that holds a whole group.

Rows are dealt by range of the order, so that a range is one partition whatever its group's size; each range's own sum is added up by group over the (few) ranges before it, and a window runs
inside a range only. The dealt table is written, as the ranges are drawn from a sample and must not be drawn again when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.scratch import written

_RANGE = "__range"


def running_sum(df: DataFrame, order: Sequence[Column], value: Column, name: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before a row, in ``order``, among those of equal ``by`` (nulls are equal).

    Rows that tie in the whole order are numbered one after the other, in any order. ``ranges`` is the number of partitions, the session's by default.
    """
    keys = [F.col(c) for c in by]
    dealt = df.repartitionByRange(ranges, *keys, *order) if ranges else df.repartitionByRange(*keys, *order)
    dealt = written(dealt.withColumn(_RANGE, F.spark_partition_id()), "ranges")
    own = dealt.groupBy(*by, _RANGE).agg(F.sum(value).alias("__own"))
    # one row for each group and range that meet: a group has at most as many as there are ranges
    before = own.withColumn("__before", F.coalesce(F.sum("__own").over(Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(_RANGE).alias("__of"), "__before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col(_RANGE) == F.col("__of"))
    inside = Window.partitionBy(*by, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return dealt.join(before, same).withColumn(name, total).drop(_RANGE, "__of", "__before", *[f"__{c}" for c in by])


def numbered(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: a row's number in ``order``, from 0, among those of equal ``by``."""
    return running_sum(df, order, F.lit(1).cast("bigint"), name, by, ranges)

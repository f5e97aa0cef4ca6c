"""Rows dealt to tasks of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Rows that one task should get.
MOST = 1_000_000


def by_keys(rows: DataFrame, keys: Sequence[str], each: float = 1, most: int = MOST) -> DataFrame:
    """``rows`` with those of a key in one partition.

    There are so many partitions that one gets about ``most`` rows where each row becomes ``each`` rows, but no more than a shuffle writes without holding its rows in
    memory (``spark.shuffle.sort.bypassMergeThreshold``): beyond that the side that deals would need the more memory the larger its table is.
    """
    count, context = rows.count(), rows.sparkSession.sparkContext
    tasks = min(count, -(-count * each // most), int(context.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200")))
    return rows.repartition(max(int(tasks), context.defaultParallelism), *keys)

"""Helpers that the operators of this subpackage share: scratch tables, components, row-wise Arrow maps."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker gets in one Arrow batch (texts can be long), and that it holds as results before it hands them back to the JVM.
IN_ROWS, OUT_ROWS = 2000, 2048


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one where that is unset.

    The temporary folder serves single-machine sessions (tests, local mode); a cluster names a shared folder in the setting.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    held = getattr(spark.sparkContext, "_frameloom_scratch", None)
    if held is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="frameloom-")
        spark.sparkContext._frameloom_scratch = held
        atexit.register(_remove, held.removeprefix("file://"))
    return held


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{scratch_dir(spark)}/frameloom/{name}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back.

    It cuts lineage, and survives lost executors: nothing is recomputed after it, and nothing lives on one machine alone. :func:`discard` deletes
    the table; what a lazy result still reads stays until whoever owns the shared folder clears it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    out._frameloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for df in tables:
        drop_table(df.sparkSession, df._frameloom_path)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, after: Callable[[], None] | None = None) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``IN_ROWS`` rows: the session's setting is lowered to it, as both sides hold whole batches of texts.

    ``after`` ends each task, in the worker, before it gives its free memory back.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= IN_ROWS:
        conf.set(name, IN_ROWS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if after is not None:
            after()
        tidy()

    return df.mapInArrow(task, schema)


def tidy() -> None:
    """Gives a process's free memory back to the machine: idle workers, and the driver's Python, stay beside a JVM."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its memory stays with the worker
        pass


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple]], after: Callable[[], None] | None = None) -> DataFrame:
    """Applies a row function to every row of ``df`` in Arrow batches.

    ``make`` runs once per task on the executor and returns the row function, which takes the columns of ``df`` in order and
    returns a tuple in the order of ``schema``. Rows leave in small batches, so a worker's memory is bounded by one input batch.
    """
    types = pa.schema([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                out = [row(*x) for x in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.types)], schema=types)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(schema))
    return map_batches(df, run, schema, after)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star contraction.

    Returns ``node, root`` for every node that has an edge to another; ``root`` is the smallest node of its component. Each
    round shuffles the edges twice and writes them to the shared folder; the number of rounds grows with the logarithm of the
    diameter. An empty edge list gives an empty table. Raises if ``rounds`` don't suffice.
    """
    spark = edges.sparkSession
    cur = materialise(
        edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("v <> u").distinct(), "edges"
    )
    seen = None
    for _ in range(rounds):
        # large star: every neighbour above a node is tied to the least of the node's neighbourhood
        both = cur.union(cur.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("m").alias("v"), "u").where("v <> u").distinct()
        # small star: every neighbour not above a node, and the node itself, is tied to the least of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("m").alias("v"), F.col("v").alias("u")))).alias("e"))
            .select("e.v", "e.u").where("v <> u").distinct()
        )
        nxt = materialise(nxt, "edges")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        old, cur = cur, nxt
        discard(old)
        if now == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = now
    raise RuntimeError("components did not settle")

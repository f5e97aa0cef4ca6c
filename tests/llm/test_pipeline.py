"""The pipeline's stages end to end on the smallest tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline
    from frameloom.llm.common import materialise
    from frameloom.llm.decontaminate import LEAST, fold

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), name)
        sizes.append(out.count())
        if name == "line_dedup":
            assert sizes[-1] == sizes[-2] and all(r.n_chars == len(r.text) for r in out.collect())
        if name == "decontamination":
            items = [fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in fold(r.text) for r in out.collect() for i in items if len(i) >= LEAST)
        if name != "byte_bpe":
            assert out.columns == columns
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert all(r.round_trip for r in docs.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "byte_bpe"]


def test_stages_on_edge_cases(spark, tmp_path):
    """Null texts, ids and labels, repeated rows, extra columns with clashing names, and empty tables."""
    import corpus_pipeline

    item = "the benchmark asks how many words a careful reader needs to tell two texts apart"
    rows = [(1, None, "x"), (2, "", "x"), (3, "One line\nof text", "y"), (3, "One line\nof text", "y"), (None, "a text without an id that is long enough", None), (4, f"before {item} after", "z"), (5, "word " * 40_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long")).withColumn("line", F.lit(1)).withColumn("h1", F.lit(2)).withColumn("fp", F.lit(3)).withColumn("__t", F.lit(4))
    for name, some, marks, items in (
        ("full", docs, [(3, 0), (None, 1), (4, None)], [(1, item), (2, None), (None, "x")]),
        ("empty", docs.limit(0), [], []),
        ("plain", docs, [], []),
    ):
        path = f"{tmp_path}/{name}"
        some.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int").withColumn("toxic", F.col("quality")).write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        out = spark.read.parquet(f"{path}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, out, path)
            assert out.columns == docs.columns, stage
        got = sorted(((r.doc_id is not None, r.doc_id or 0) for r in out.collect()))
        want = {"full": [(False, 0), (True, 1), (True, 3), (True, 5)], "empty": [], "plain": [(False, 0), (True, 1), (True, 3), (True, 4), (True, 5)]}[name]
        assert got == want
        last = corpus_pipeline.run(spark, path)
        assert last.count() == len(want) and all(r.round_trip for r in last.collect())

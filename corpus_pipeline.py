"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go; repeated lines go from the texts; of each group of near duplicates one document stays; documents with a benchmark item go;
what is left is encoded. Every stage but the last returns the columns of its input, and works on every row that it gets.

Defined results: a null or empty text is clean, has no line to drop, has fingerprint zero (of all documents without words one stays) and no benchmark item, and encodes to no tokens.
A null id is an id before all others; repeated rows are near duplicates of each other, of which one stays; ties go to the least id, then to the least hash of the text. Empty tables give
empty results (without labels nothing is toxic, without a benchmark nothing contaminated). Further columns are kept as they are, ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from frameloom.llm.common import discard, materialise
from frameloom.llm.registry import fold, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, by a machine trained on the labels outside the held-out fold."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(4) != 2)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that come earlier in the corpus; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document that is left, with digests of the ids and of what they decode to."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("simhash", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("byte_bpe", encode),
]

#: No SQL: the stages train a classifier, match within edits, and hash and tokenise with libraries. They are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents`` in order."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs

"""The ``opN_<name>`` queries: each operator over its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import statements


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def fold(modulus: int):
    from pyspark.sql import functions as F

    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from frameloom.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels.where(fold(4) != 2))
    held = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    return toxicity.scores(docs, machine).select("doc_id", held, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from frameloom.llm import language_id

    docs = table(spark, sf_dir, "documents")
    filters = language_id.fit(docs.where(fold(5) != 0))
    return language_id.predictions(docs, filters).select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from frameloom.llm.token_store import store_documents

    return store_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents"), secrets.fit(spark))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from frameloom.llm.byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_token_store": op5_token_store,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_mixing": op12_mixing,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op11_vector_codes": statements.vector_codes(), "op12_mixing": statements.mixing(), "op13_collocations": statements.collocations()}

"""The corpus pipeline: five stages over documents, each reading what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import scratch
from fieldloom.llm.decontaminate import contamination
from fieldloom.llm.linededup import dedup_lines
from fieldloom.llm.neardup import first_of_classes
from fieldloom.llm.packing import pack
from fieldloom.llm.quality_rules import quality
from fieldloom.llm.queries import tokenizer_file
from fieldloom.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it now is."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines too common in their host."""
    return _documents(quality(docs, with_text=True).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated lines only in the smallest doc_id that holds them."""
    return _documents(dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8) one document, with the smallest doc_id; rows without one stay."""
    return first_of_classes(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no phrase of the benchmark."""
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("_doc", "_row").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = (F.coalesce(F.col("doc_id"), F.lit(-(2**63))) == F.col("_doc")) & (F.xxhash64(text) == F.col("_row"))
    return docs.join(hit, same, "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences."""
    return pack(docs, tokenizer_file())


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontaminate", decontaminate), ("packing", packing),
]

#: Fingerprints and tokens have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

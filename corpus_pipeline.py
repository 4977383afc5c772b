"""A corpus from raw documents to packed batches: five stages, each over all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm.line_dedup import drop_common_lines
from notewright.llm.packing import pack
from notewright.llm.quality_rules import rate_quality
from notewright.llm.shared import drop, table_scope, written
from notewright.llm.shingle_join import one_of_each_group
from notewright.llm.source_mixing import mixed_rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return rate_quality(docs, min_words=50, most_repeat_percent=50, keep=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them share."""
    out = drop_common_lines(docs, min_documents=10, min_chars=1)
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return one_of_each_group(docs, words=5, percent=75)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_rows(docs, weights=[5.0, 2.0, 1.0], cap=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets and batches of all that the mix holds."""
    return pack(docs, max_length=2048, buckets=8, budget=16384)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: SQL has no zstandard ratio and no shingle join, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with table_scope() as tables:
            after = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            tables.keep(after)
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

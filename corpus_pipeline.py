"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
to the shared folder as Parquet and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import staged
from quarry.llm.decontam import find_leaks, without_leaks
from quarry.llm.jaccard import without_near_copies
from quarry.llm.line_dedup import drop_repeated_lines
from quarry.llm.packing import packing_query
from quarry.llm.quality import score_quality, train_quality
from quarry.llm.queries import tokenizer_path

#: Documents with a score of at least this are kept.
QUALITY = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from labelled documents
    of the table, the held-out ones left out."""
    net = train_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return score_quality(docs, net, score_col="quality_score").where(F.col("quality_score") >= QUALITY).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; n_chars follows the text."""
    out = drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents without words all stay."""
    return without_near_copies(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    leaks = staged(find_leaks(docs, _table(spark, sf_dir, "benchmark")), "leaks")
    return without_leaks(docs, leaks).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing_query(docs, tokenizer_path())


STAGES = [("quality", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]

#: The classifier and the latent space have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

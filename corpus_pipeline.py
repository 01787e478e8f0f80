"""A training corpus from raw documents: five stages, each written and read again as the next one's input.

Every stage reads COLUMNS alone, so other columns, whatever their names, go; an empty table stays empty; texts are read whole,
whatever their length; ids, languages and sources may be null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstats.llm import decontam, jaccard, linededup, mixing, quality
from gridstats.llm.shared import discard, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Five words, similarity 0.8.
NEAR = jaccard.Spec(words=5, num=80, den=100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored as empty ones, equal rows alike."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, and with them documents of which nothing else is left; n_chars follows the text.

    Null and blank texts stay as they are; rows equal in id and text count as one place, so both stay or are cut alike.
    """
    cut = linededup.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | (F.trim(F.col("text"), F.lit(" \t\r\n")) != "")
    return cut.where(left).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Texts without words are no copies of each other and stay; of rows equal in id and text one stays.
    """
    return jaccard.keep_one(docs.select(*COLUMNS), NEAR)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and rows that are equal go or stay together.

    There are no ties: whether a document holds an item depends on the two texts alone.
    """
    return decontam.drop_leaking(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes: the columns of documents, copies, copy (from 1).

    Rows equal in id, text and source are one document here; texts without words have no size and are not taken.  Ties of draws are
    broken by id, size and text, so reruns agree.
    """
    docs = docs.select(*COLUMNS).dropDuplicates(["doc_id", "text", "source"])
    taken = mixing.mix(docs).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("th").alias("_th"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.xxhash64("text") == F.col("_th"))
    return docs.join(taken, same).select(*COLUMNS, "copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The quality, near-copy and mixing stages have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # the stage before it has been read
        before = docs
    return docs

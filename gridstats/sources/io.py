"""Scans and sinks of grid tables."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: <scenario>_<member>, with or without the name of a partition column before it.
RUN_PATTERN = r"^(?:[^/_=]+=)?([^/_=]+(?:_[^/_=]+)*)_([^/_=]+)$"


def run_folders(spark: SparkSession, path: str, pattern: str = RUN_PATTERN) -> list[tuple[str, str, str]]:
    """(folder, scenario, member) of the run folders right under path, from their names; no file is opened."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)
    named = [(str(x.getPath()), re.match(pattern, x.getPath().getName())) for x in found if x.isDirectory()]
    return sorted((folder, m[1], m[2]) for folder, m in named if m)


def scan_runs(spark: SparkSession, path: str, pattern: str = RUN_PATTERN, scenarios: Iterable[str] | None = None, members: Iterable[str] | None = None) -> DataFrame:
    """Parquet under <scenario>_<member> folders, with both from the folders' names.

    Names are matched before anything is opened, so runs that are not asked for cost nothing; the others are read as one table.
    """
    wanted = lambda names, x: names is None or x in set(names)
    scenarios, members = (None if x is None else list(x) for x in (scenarios, members))
    chosen = [(f, s, m) for f, s, m in run_folders(spark, path, pattern) if wanted(scenarios, s) and wanted(members, m)]
    if not chosen:
        raise ValueError(f"no such runs under {path}")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    df = spark.read.parquet(*[f for f, _, _ in chosen])
    return df.withColumns({"scenario": F.regexp_extract(folder, pattern, 1), "member": F.regexp_extract(folder, pattern, 2)})


def scan_months(df: DataFrame, first: int, last: int, months: Iterable[int] | None = None, time: str | None = None) -> DataFrame:
    """Only the listed months of the years: on tables partitioned by year and month this prunes folders.

    Where `year` is derived, name the day it comes from as `time`: its range reaches the scan.
    """
    out = df.where(F.col("year").between(first, last))
    if time is not None:
        out = out.where((F.col(time) >= F.lit(date(first, 1, 1))) & (F.col(time) < F.lit(date(last + 1, 1, 1))))
    return out if months is None else out.where(F.col("month").isin(list(months)))


def scan_all(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def tag_and_stack(frames: Iterable[tuple[dict[str, object], DataFrame]]) -> DataFrame:
    """All frames below each other with their tags as columns; absent variables are NULL."""
    out = None
    for tags, df in frames:
        tagged = df.withColumns({k: F.lit(v) for k, v in tags.items()})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to stack")
    return out


def read_codes(spark: SparkSession, path: str, schema: T.StructType | str = "code int, name string") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def coefficients(table: DataFrame, names: dict[str, str] | None = None, without: Iterable[str] = ("(Intercept)", "year")) -> DataFrame:
    """Estimates and variances of model terms, renamed to variables, without fixed effects."""
    out = table.where(~F.col("term").isin(list(without))).select(
        *[c for c in table.columns if c not in ("estimate", "std_error")], "estimate", F.pow("std_error", F.lit(2)).alias("estimate_var")
    )
    return out if not names else out.replace(names, subset=["term"])


def absent_pairs(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(have.select(*keys).distinct(), keys, "left_anti")


def write_grid(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "zstd") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def write_yearly(df: DataFrame, path: str, keys: Iterable[str] = ("scenario", "member", "year")) -> None:
    """One folder a scenario, member and year; folders that are written replace their old content, others stay."""
    keys = list(keys)
    # Rows of a folder meet in a few tasks by cell, so folders get few files and no task a whole scenario.
    spread = [F.pmod(F.hash(*[c for c in ("lat", "lon") if c in df.columns]), F.lit(4))] if {"lat", "lon"} & set(df.columns) else []
    df.repartition(*[F.col(k) for k in keys], *spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_summary_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def variable_meta(spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "variable string, units string, long_name string")


def path_column() -> Column:
    return F.col("_metadata.file_path")

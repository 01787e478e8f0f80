"""Queries by name, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, r: str = "", digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query; the columns in r are rounded on both sides, as sums differ in their last bits.

    The data hold few decimals, so exact halves occur; a small shift keeps them from the border.
    """
    cols = r.split()
    shift = 3.7 * 10.0 ** -(digits + 2)

    def put(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c) + shift, digits) + 0.0 for c in cols}) if cols else df

        QUERIES[name] = run
        if sql:
            ORACLE[name] = f"SELECT * REPLACE ({', '.join(f'round({c} + {shift!r}, {digits}) + 0.0 AS {c}' for c in cols)}) FROM ({sql})" if cols else sql
        return f

    return put

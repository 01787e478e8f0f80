"""Queries of the subpackage beside their SQL on the given tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from gridstats.llm.queries import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(ORACLE[name])
    columns = sorted(x[0] for x in found.description)
    place = [[x[0] for x in found.description].index(c) for c in columns]
    want = sorted(([r[i] for i in place] for r in found.fetchall()), key=repr)
    df = QUERIES[name](spark, str(SF))
    assert sorted(df.columns) == columns
    assert sorted((list(r) for r in df.select(*columns).collect()), key=repr) == want

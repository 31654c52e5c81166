"""Registered queries against their SQL."""

import duckdb
import pytest

from quadrivo.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    got = queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)

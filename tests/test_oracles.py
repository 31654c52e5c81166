"""Every registered query with an oracle against DuckDB on the smallest tables; the others run."""

import datetime
import decimal

import duckdb
import pytest

from quadrivo.plans import registry
from quadrivo.plans.lens import LENS, SOURCES, Lens, duckdb_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for name in SOURCES:
        made.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return made


def rows(found):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v.isoformat() if isinstance(v, datetime.datetime) else v

    return sorted((tuple(plain(v) for v in r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(LENS))
def test_lens(spark, db, name):
    got, want = Lens(spark, SF)[name], db.sql(duckdb_sql(f"SELECT * FROM ${name}"))
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE_SQL:
        assert got.count() > 0
        return
    want = db.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    have, expected = rows(got.select(*columns).collect()), rows(want.select(*columns).fetchall())
    assert have == expected
    assert have or name == "reminders_without_sync"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: kinds.get(t, t) for c, t in got.dtypes} == {c: types[c] for c, _ in got.dtypes} or not have, (got.dtypes, types)

"""Work on large tables in parts of a bounded number of rows: the same results, and no part that grows with the table."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quadrivo.operators import orders, reminders, state
from quadrivo.plans import lens, registry
from quadrivo.plans.lens import Lens
from quadrivo.sources import parts, schema


@pytest.fixture
def small(monkeypatch):
    """Parts of few rows, so that small tables are large ones."""
    monkeypatch.setattr(parts, "ROWS", 500)


def dealt_by(df):
    """Columns and number of parts of the plan's shuffles."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return {(re.sub(r"#\d+L?", "", columns), int(n)) for columns, n in re.findall(r"(?:hash|range)partitioning\((.*?), (\d+)\)", text)}


def test_rule_sets_are_replaced_in_parts(spark, small):
    """Against each set by itself; a set with a repeated id, a shared or null offset, one too narrow band or one that is not before the deadline changes nothing."""
    hour = 3600
    good = [("a", hour), ("b", 5 * hour)]
    kinds = [good, [*good, ("a", 9 * hour)], [*good, ("c", hour)], [("a", 0)], [*good, ("c", hour + 1)], [("a", None)], [*good, (None, 9 * hour), (None, 20 * hour)]]
    drafts = [(s, i, o, "t", "b") for s in range(700) for i, o in kinds[s % len(kinds)]]
    brought = spark.createDataFrame(drafts, "set_id long, id string, offset_seconds long, title_template string, body_template string")
    stored = spark.range(900).selectExpr("id AS set_id", "'old' AS id", "7L AS offset_seconds", "false AS enabled", "'t' AS title_template", "'b' AS body_template", "'then' AS updated_at")
    problems = {}
    for s, i, problem in reminders.violations(brought, "set_id").collect():
        problems.setdefault(s % len(kinds), set()).add((i, problem))
    assert problems == {1: {("a", "duplicate id")}, 2: {("a", "duplicate offset")}, 3: {("a", "not before the deadline")}, 4: {("c", "band too narrow")}, 6: {(None, "duplicate id")}}
    got = state.replace_rule_sets(stored, brought, "now", "set_id")
    want = [(s, i, o, True, "now") for s, i, o, _, _ in drafts if s % len(kinds) in (0, 5)] + [(s, "old", 7, False, "then") for s in range(900) if s >= 700 or s % len(kinds) not in (0, 5)]
    assert sorted(map(tuple, got.select("set_id", "id", "offset_seconds", "enabled", "updated_at").collect()), key=str) == sorted(want, key=str)
    n = -(-(brought.count() + 900) // 500)
    assert dealt_by(got) == {("set_id", n)}
    violations = reminders.violations(brought, "set_id")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", violations)) == 2


def test_small_tables_lie_as_they_do(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    assert parts.dealt(df, 100, "k") is df
    assert parts.parts(spark, parts.ROWS) is None and parts.parts(spark, parts.ROWS * 100 + 1) == 101
    assert parts.parts(spark, parts.MOST * 200) == 200 and parts.parts(spark, parts.MOST * 300) == 300


def test_grades_are_joined_and_numbered_in_parts(spark, small):
    """grades_all: one shuffle of each source table, by order, in parts for its rows."""
    sf = "/root/testdata/sf0.001"
    n = min(200, -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500))
    got = Lens(spark, sf)["grades"]
    assert {("l_orderkey", n), ("o_orderkey", n)} == dealt_by(got)
    want = duckdb.sql(registry.ORACLE_SQL["grades_all"].replace("FROM lineitem JOIN orders", f"FROM '{sf}/lineitem.parquet' JOIN '{sf}/orders.parquet'"))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
    one = registry.QUERIES["grades_by_course"](spark, sf)
    assert sorted(r.id for r in one.collect()) == sorted(r[0] for r in want.filter("course_id = 10").select("id").fetchall())


def test_grades_of_a_course_are_made_of_its_orders_lines(spark, tmp_path, monkeypatch):
    """No other line is shuffled or sorted; where keys of orders repeat, within the course or with another one, rows are numbered as in the whole table."""
    sf = "/root/testdata/sf0.001"
    orders, lines = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("orders", "lineitem"))
    kind, keys = orders.schema["o_custkey"].dataType, [r.o_orderkey for r in orders.filter("o_custkey = 10").orderBy("o_orderkey").collect()]
    again = orders.filter(F.col("o_orderkey").isin(keys[:2])).withColumn("o_custkey", F.when(F.col("o_orderkey") == keys[0], 10).otherwise(11).cast(kind))
    orders.unionByName(again).write.parquet(f"{tmp_path}/orders.parquet")
    lines.unionByName(lines.filter("l_linenumber = 1")).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Lens(spark, str(tmp_path))
    got = t.grades_of(10)
    table = duckdb.sql(registry.ORACLE_SQL["grades_all"].replace("FROM lineitem JOIN orders", f"FROM '{tmp_path}/lineitem.parquet/*.parquet' JOIN '{tmp_path}/orders.parquet/*.parquet'")).fetchall
    want = [r[0] for r in table() if r[0] // 512 in keys]
    assert len(want) > len(keys) and sorted(r.id for r in got.collect()) == sorted(want)
    # Of a key with orders of two courses it is open which of them has which number; all else is told.
    row = lambda r: str((r[0] // 512 if r[0] // 512 == keys[1] else r[0], *r[1:3]))
    asked = sorted(row(r) for r in table() if r[1] == 10)
    assert sorted(row(r) for r in registry.QUERIES["grades_by_course"](spark, str(tmp_path)).collect()) == asked
    plan = registry.QUERIES["grades_by_course"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2 and "RepartitionByExpression" not in plan
    monkeypatch.setattr(lens, "FEW", 1)
    assert sorted(row(r) for r in registry.QUERIES["grades_by_course"](spark, str(tmp_path)).collect()) == asked


def test_orders_are_sorted_in_parts(spark, small):
    """As many ranges as the rows need, whatever the shuffle partitions are (4 here), and each row's neighbour as before."""
    rows = spark.range(20_000, numPartitions=3).selectExpr("id", "if(id % 11 = 0, null, hash(id) % 50) AS a")
    order = [F.asc_nulls_first("a"), F.asc("id")]
    made, _, part, place = orders.ranged(rows, order, "id")
    ranges = made.groupBy(part).agg(F.max(place).alias("last")).collect()
    assert 20 < len(ranges) <= 40 and max(r.last for r in ranges) < 3 * 500
    got = orders.with_previous(rows, order, "id", "after")
    want = rows.selectExpr("*", "lag(id) OVER (ORDER BY a ASC NULLS FIRST, id) AS after")
    assert got.count() == 20_000 and got.exceptAll(want).isEmpty()


def test_grades_are_packed_into_payloads_in_parts(spark, small):
    sf = "/root/testdata/sf0.001"
    t, got = Lens(spark, sf), registry.QUERIES["normalize_grades"](spark, sf)
    n = parts.parts(spark, t.rows("lineitem"))
    assert {("course_id", n), ("l_orderkey", n), ("o_orderkey", n)} == dealt_by(got)
    want = t["grades"].select(*got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_keys_that_many_rows_refer_to_are_met_where_they_lie(spark, small):
    """Present and missing keys of 3,000 rows each, beside those of one row; null references are none."""
    empty = {n: schema.empty(spark, n) for n in ("users", "courses", "grades")}
    filled = lambda n, df: empty[n].unionByName(df, allowMissingColumns=True)
    tables = {
        "users": filled("users", spark.range(2).selectExpr("id")),
        "courses": filled("courses", spark.range(4_000).filter("id % 5 <> 0").selectExpr("id")),
        "grades": filled("grades", spark.range(9_000).selectExpr("id", "if(id % 7 = 0, null, id % 6000) AS course_id", "if(id % 3 = 0, null, id % 3) AS user_id")),
    }
    often = {tuple(r) for r in schema.crowded(schema.references(tables).filter("child IS NOT NULL"), 500).collect()}
    assert {("users", 1), ("users", 2)} <= often
    got = sorted(map(tuple, schema.fk_violations(tables).collect()))
    want = [("grades", "course_id", str(i)) for i in range(9_000) if i % 7 and (i % 6000 >= 4_000 or i % 6000 % 5 == 0)] + [("grades", "user_id", str(i)) for i in range(9_000) if i % 3 == 2]
    assert got == sorted(want)
    plain = spark.createDataFrame([("t", k, "c", "r", str(i)) for k in (1, 2) for i in range(200_000 if k == 1 else 200)], "table_name string, key long, child string, reference string, id string")
    assert [tuple(r) for r in schema.crowded(plain, 100_000).collect()] == [("t", 1)]

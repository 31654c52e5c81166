"""Orders of whole tables under any partitioning, and plans that read each table once or stay in the JVM."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrivo.operators import orders, reminders
from quadrivo.plans import registry
from quadrivo.plans.lens import SOURCES
from quadrivo.sources import platform, schema

ORDERED = ["courses_ordered", "assignments_by_duedate", "grades_ordered", "calendar_ordered", "modules_ordered", "materials_ordered", "abandoned_ordered", "deferrals_biggest"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    before = {}

    def put(**values):
        for k, v in values.items():
            key = {"aqe": "spark.sql.adaptive.enabled", "parts": "spark.sql.shuffle.partitions", "small": "spark.sql.adaptive.advisoryPartitionSizeInBytes"}[k]
            before.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, v)

    yield put
    for key, v in before.items():
        spark.conf.set(key, v)


@pytest.mark.parametrize("aqe,parts", [("true", "4"), ("true", "200"), ("false", "4"), ("false", "8"), ("false", "64")])
def test_each_row_says_which_stands_before_it(spark, conf, aqe, parts):
    """With nulls, ties in the first column, ranges that Spark joins or not, and a column that has the helper's name."""
    conf(aqe=aqe, parts=parts, small="64k")
    rows = spark.range(120_000, numPartitions=7).selectExpr("id", "if(id % 11 = 0, null, hash(id) % 500) AS a", "concat('n', id % 3) AS _range")
    got = orders.with_previous(rows, [F.desc_nulls_last("a"), F.asc("id")], "id", "after")
    assert got.columns == ["id", "a", "_range", "after"]
    by = "ORDER BY a DESC NULLS LAST, id"
    want = rows.selectExpr("*", f"lag(id) OVER ({by}) AS after")
    assert got.count() == 120_000 and got.exceptAll(want).isEmpty()
    assert orders.with_previous(rows.limit(0), [F.asc("id")], "id", "after").count() == 0
    assert orders.with_previous(rows.limit(1), [F.asc("id")], "id", "after").first().after is None


@pytest.mark.parametrize("aqe,parts", [("true", "16"), ("false", "8")])
def test_ordered_queries(spark, conf, aqe, parts):
    conf(aqe=aqe, parts=parts)
    sf, db = "/root/testdata/sf0.01", duckdb.connect()
    for name in SOURCES:
        db.sql(f"CREATE VIEW {name} AS FROM '{sf}/{name}.parquet'")
    for name in ORDERED:
        got = registry.QUERIES[name](spark, sf)
        key = "id" if "id" in got.columns else "version_id" if "version_id" in got.columns else "resource_id"
        want = dict(db.sql(registry.ORACLE_SQL[name]).select(key, "after").fetchall())
        assert {r[0]: r[1] for r in got.select(key, "after").collect()} == want, name


def test_references_read_each_table_once(spark, tmp_path):
    tables = {}
    for name in ("users", "courses", "sections", "modules", "files", "assignments", "submissions", "grades", "resources", "versions", "extractions"):
        where = f"file://{tmp_path}/{name}"
        schema.empty(spark, name).write.parquet(where)
        tables[name] = spark.read.schema(schema.schema(name)).parquet(where)
    assert plan(schema.references(tables)).count("FileScan parquet") == len(tables)
    scan = plan(schema.references({n: tables[n] for n in ("extractions", "versions")}))
    assert "extracted_text" not in scan and "Python" not in scan
    with pytest.raises(ValueError):
        schema.references({"users": tables["users"]})


def test_references_are_met_by_table_and_key(spark):
    empty = {n: schema.empty(spark, n) for n in schema.COLUMNS}

    def rows(table, *given):
        names = empty[table].columns
        return spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], empty[table].schema)

    tables = empty | {
        "courses": rows("courses", {"id": 1}),
        "sections": rows("sections", {"id": 10, "course_id": 1}, {"id": 11, "course_id": 2}, {"id": 12}),
        "modules": rows("modules", {"id": 1, "course_id": 1, "section_id": 10}, {"id": 2, "course_id": 11, "section_id": 1}, {"id": 3}),
    }
    got = sorted(map(tuple, schema.fk_violations(tables).collect()))
    assert got == [("modules", "course_id", "2"), ("modules", "section_id", "2"), ("sections", "course_id", "11")]


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.sampled_from(["", "a b", "é", "1", "true", "[x]", "null"]), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["a", "b c", "é"]), inner, max_size=3), max_leaves=12)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b", "c"]), VALUES, max_size=3) | st.lists(VALUES, max_size=3), min_size=20, max_size=40))
def test_form_fields_are_those_of_calls(spark, given):
    import json

    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(given)], "i long, params string")
    got = sorted((r.i, r.field, r.value) for r in platform.form_fields(df, "params", "i").collect())
    assert got == sorted((i, k, v) for i, p in enumerate(given) for k, v in platform.flatten(p).items())


def test_form_fields_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": {"c": [1]}}]}'), (2, None), (3, "{}")], "i long, params string")
    got = platform.form_fields(df, "params", "i")
    assert [tuple(r) for r in got.collect()] == [(1, "a[0][b][c][0]", "1")]
    assert "Python" not in plan(got) and "Pandas" not in plan(got) and "Arrow" not in plan(got)


def test_bands_of_many_sets(spark):
    """Against all rules of a set, one by one; a set without rules has no band, and the narrowest band has no lower end."""
    hour = 3600
    sets = {1: [("a", hour), ("b", 5 * hour), ("c", 40 * hour)], 2: [("a", 3 * hour)], 3: [("z", 7)], 4: [("never", -5), ("late", 100)]}
    rules = spark.createDataFrame([(s, i, o, "t", "b") for s, given in sets.items() for i, o in given], "set_id long, id string, offset_seconds long, title_template string, body_template string")
    times = [-9 * hour, -1, 0, 1, 2, 7, 8, hour - 1, hour, hour + 1, 2 * hour, 3 * hour, 5 * hour, 5 * hour + 1, 39 * hour, 41 * hour]
    tasks = spark.createDataFrame([(s * 100 + i, s, 1000 + t) for s in (1, 2, 3, 4, 5) for i, t in enumerate(times)], "id long, set_id long, duedate long")
    found = reminders.in_band(tasks, rules, 1000, by="set_id")
    got = {r.id: r.rule_id for r in found.collect()}
    want = {s * 100 + i: min((o, n) for n, o in given if o >= t)[1] for s, given in sets.items() for i, t in enumerate(times) if any(o >= t for _, o in given)}
    assert got == want and "NestedLoop" not in plan(found)
    one = reminders.in_band(tasks.filter("set_id = 1"), rules.filter("set_id = 1"), 1000)
    assert {r.id: r.rule_id for r in one.collect()} == {k: v for k, v in want.items() if k < 200}
    assert "NestedLoop" not in plan(one) and "BroadcastHashJoin" in plan(one)

"""Decision rules on small fixtures."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quadrivo.functions import instants, rules, text
from quadrivo.operators import history, latest, queues, read_model, reminders, state
from quadrivo.sources import schema

N, D, H = 1_705_320_000, 86_400, 3600


def one(spark, column, **values):
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean", type(None): "bigint"}
    df = spark.range(1).select(*(F.lit(v).cast(kinds[type(v)]).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column).first()[0]


def test_pending_and_upcoming(spark):
    assignments = spark.createDataFrame([(1, 1, N + D), (2, 1, N + D), (3, 1, N - D), (4, 1, 0), (5, 1, N + D), (6, 2, N + D), (7, 2, N), (8, 2, N + 7 * D), (9, 2, N + 7 * D + 1), (10, 2, None)], "id long, course_id long, duedate long")
    for c in ("name string", "allowsubmissionsfromdate long", "cutoffdate long", "grade double", "last_synced_at string"):
        assignments = assignments.withColumn(c.split()[0], F.lit(None).cast(c.split()[1].replace("long", "bigint")))
    status = spark.createDataFrame([(1, "new"), (2, "submitted"), (3, "new"), (4, "new"), (6, "new"), (7, "draft"), (8, None), (10, "new")], "assignment_id long, submission_status string").withColumn("grading_status", F.lit("g"))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(read_model.pending_assignments(assignments, status, N)) == [1, 6, 7]
    assert ids(read_model.assignments(assignments, status, N).filter("is_pending")) == [1, 6, 7]
    assert ids(read_model.pending_assignments(assignments, status, N, 2)) == [6, 7]
    assert ids(read_model.upcoming_assignments(assignments, status, N)) == [1, 2, 5, 6, 7, 8]
    assert read_model.assignments(assignments, status, N).count() == 10
    assert ids(queues.needs_status(assignments, status, N)) == [1, 5, 6, 8, 9]


def test_pending_is_pushed_down(spark):
    from quadrivo.plans.lens import Lens

    t = Lens(spark, "/root/testdata/sf0.001")
    plan = read_model.pending_assignments(t["assignments"], t["submissions"], N)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "LeftOuter" not in plan
    plan = read_model.materials(t["resources"], t["versions"], t["extractions"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "extracted_text" not in plan


def test_bands_and_words(spark):
    rows = [(i, int(h * H)) for i, h in enumerate((500, 25, 24, 20, 12.01, 12, 8, 6, 5, 1, 0.25, 0))]
    given = [reminders.Rule(f"{h}h", h * H) for h in (24, 12, 6, 1)]
    tasks = spark.createDataFrame([(i, N + left) for i, left in rows], "id long, duedate long")
    found = {r.id: r.rule_id for r in reminders.in_band(tasks, reminders.rule_table(spark, given), N).collect()}
    assert [found.get(i) for i, _ in rows] == [None, None, "24h", "24h", "24h", "12h", "12h", "6h", "6h", "1h", "1h", "1h"]
    few = {r.id: r.rule_id for r in reminders.in_band(tasks, reminders.rule_table(spark, [given[0], *given[2:]]), N).collect()}
    assert (few[6], few[7]) == ("24h", "6h")
    for seconds, words in ((30, "menos de un minuto"), (60, "1 minuto"), (1500, "25 minutos"), (3594, "59 minutos"), (3600, "1 hora"), (36000, "10 horas"), (int(23.98 * H), "23 horas"), (24 * H, "1 dia"), (47 * H, "1 dia"), (48 * H, "2 dias")):
        assert one(spark, instants.remaining_words("s"), s=seconds) == words


def test_candidates_and_identity(spark):
    cols = "id long, course_id long, name string, duedate long, last_synced_at string"
    a = spark.createDataFrame([(1, 1, "{course}", N + 10 * H, "2024-02"), (2, 1, "b", N + 10 * H, "2024-02"), (3, 1, "c", N + 48 * H, "2024-02"), (4, 1, "d", N - H, "2024-02"), (5, 1, "e", N + 10 * H, "2024-02"), (6, 1, "f", N + 10 * H, "2023"), (7, 9, "g", N, None)], cols)
    s = spark.createDataFrame([(1, "new"), (2, "submitted"), (3, "new"), (4, "new"), (6, "new"), (7, "new")], "assignment_id long, submission_status string")
    given = [reminders.Rule(f"{h}h", h * H, "{assignment}", "{{x}} {course} {due} {remaining} {tz}") for h in (24, 12, 6, 1)]
    found = reminders.candidates(a, s, reminders.rule_table(spark, given), N, "2024-01")
    assert [(r.subject_key, r.notification_type, r.scheduled_for) for r in found.collect()] == [("assignment:1", "assignment_due_12h", "2024-01-15T22:00:00+00:00")]
    courses = spark.createDataFrame([(2, "Other")], "id long, fullname string")
    m = reminders.messages(found, courses, given).first()
    assert (m.title, m.body) == ("{course}", "{x} Curso 1 2024-01-15 18:00 10 horas America/Santo_Domingo")
    sent = found.select("notification_type", "subject_key", "scheduled_for")
    assert reminders.unsent(found, sent).count() == 0
    assert reminders.unsent(found, sent.withColumn("scheduled_for", F.lit("moved"))).count() == 1
    assert reminders.candidates(a, s, reminders.rule_table(spark, []), N, "2024-01").count() == 0


@pytest.mark.parametrize("bad", [[("a", 24 * H), ("b", 23 * H + 1801)], [("a", 1800)], [("a", H), ("a", 3 * H)], [("a", H), ("b", H)], [("a", 0)]])
def test_bad_rules(bad):
    with pytest.raises(reminders.RuleError):
        reminders.validate([reminders.Rule(*b) for b in bad])


def test_rule_templates():
    reminders.validate([])
    reminders.validate([reminders.Rule("a", H, "{{literal}} {due_date}")])
    for template in ("{nobody}", "{", "}", "{0}", "{}"):
        with pytest.raises(reminders.RuleError):
            reminders.validate([reminders.Rule("a", H, template)])


def test_grid(spark):
    zone = ZoneInfo("America/Santo_Domingo")
    at = lambda *x: int(dt.datetime(*x, tzinfo=zone).timestamp())
    for now, hours, want in (((2026, 9, 1, 17, 43), 1, (2026, 9, 1, 18)), ((2026, 9, 1, 17, 43), 6, (2026, 9, 1, 18)), ((2026, 9, 1, 8), 6, (2026, 9, 1, 12)), ((2026, 9, 1, 12), 6, (2026, 9, 1, 18)), ((2026, 9, 1, 23, 30), 6, (2026, 9, 2, 0))):
        assert one(spark, instants.next_slot("s", hours).cast("bigint"), s=at(*now)) == at(*want)
        from quadrivo.control.scheduler import next_slot

        assert next_slot(dt.datetime(*now, tzinfo=zone), hours) == dt.datetime(*want, tzinfo=zone)
    assert instants.GRID_HOURS == (1, 2, 3, 4, 6, 8, 12, 24)
    with pytest.raises(ValueError):
        instants.next_slot("s", 5)


def test_sufficiency_and_limits(spark):
    for pages, least, want in (([], 50, False), ([200] * 5, 50, True), ([0] * 3, 50, False), ([300] * 8 + [0] * 2, 50, True), ([500] + [0] * 9, 50, False), ([30] * 3, 50, False), ([30] * 3, 20, True), ([1, 60], 50, True)):
        assert one(spark, rules.sufficient(F.lit(pages).cast("array<int>") if pages else F.array().cast("array<int>"), least)) is want
    members = F.array(*(F.struct(F.lit(s).alias("size"), F.lit(p).alias("packed")) for s, p in ((51 << 20, 51 << 20), (10, 0), (1000, 9), (50 << 20, 50 << 20), (50 << 20, 50 << 20), (50 << 20, 50 << 20), (50 << 20, 50 << 20), (100, 100))))
    assert one(spark, rules.safe_members(members)) == [False, True, False, True, True, True, False, True]


def test_text_rules(spark):
    assert one(spark, text.strip_markup("v"), v="  <p>a &amp; b</p>\t ") == "a &amp; b"
    assert one(spark, text.strip_markup("v"), v="<br> ") is None
    assert one(spark, text.redact("v", ["hunter22", "tiny"]), v="wsTOKEN=abc&x Token=q' 123456:" + "A" * 30 + " hunter22 tiny") == "wsTOKEN=***&x Token=***' *** *** tiny"
    assert len(one(spark, text.safe_error("k", "v"), k="E", v="x" * 2000)) == 1000
    assert one(spark, text.message("k", "v"), k="t", v="x" * 5000)[-1] == "…"
    assert one(spark, text.subject_id("v"), v="assignment:12") == 12 and one(spark, text.subject_id("v"), v="assignment:1x") is None
    for name, want in (("A.PDF", ".pdf"), (".bashrc", ""), ("a.tar.gz", ".gz"), ("none", ""), ("d.x/none", "")):
        assert one(spark, text.extension("v"), v=name) == want
    for url, scheme, want in (("https://h.edu/x", "https", True), ("http://h.edu/x", "https", False), ("http://h.edu", "http", True), ("https://h.edu", "http", True), ("https://a.h.edu/", "https", False), ("https://h.edu@evil.org/", "https", False), ("https://u@H.edu:8443/", "https", True), ("ftp://h.edu", "http", False), ("x", "https", False)):
        assert one(spark, text.trusted("v", "h.edu", scheme), v=url) is want
    assert one(spark, text.authenticated_url("v", "a b"), v="https://h/f?x=1&TOKEN=old#z") == "https://h/f?x=1&token=a+b#z"
    assert one(spark, text.redact_url("v"), v="https://h/f?token=s&x=1") == "https://h/f?token=%2A%2A%2A&x=1"


def test_three_valued_current_rows(spark):
    sections = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "course_id long, last_synced_at string")
    rows = spark.createDataFrame([(1, 1, "b"), (2, 1, "a"), (3, 1, None), (4, 2, "z"), (5, 3, "z"), (6, 1, "c")], "id long, course_id long, last_synced_at string")
    assert sorted(r.id for r in queues.current_rows(rows, sections).collect()) == [1, 6]


def test_pending_and_abandoned_share_what_is_open(spark):
    versions = spark.createDataFrame([(i, i, 1, 5, "m") for i in range(1, 9)] + [(100, 1, 2, 5, "m")], "id long, resource_id long, version_number long, size_bytes long, mimetype string")
    rows, n = [], 0
    for v, kinds in {1: "fff", 2: "ff", 3: "fffd", 4: "fffu", 5: "ffff", 6: "", 7: "dfff", 100: "fff"}.items():
        for k in kinds:
            n += 1
            rows.append((n, v, "basic", "unsupported" if k == "u" else "x", "done" if k == "d" else "failed", None if n % 2 else f"e{n}", f"t{n:03}"))
    rows.append((n + 1, 6, "deep", "x", "failed", "deep", "t"))
    e = spark.createDataFrame(rows, "id long, resource_version_id long, depth string, extractor_name string, status string, error_reason string, extracted_at string")
    r = spark.createDataFrame([(i, f"n{i}", 1) for i in range(1, 9)], "id long, name string, course_id long")
    pending = {x.id: x.failed_count for x in queues.pending_extraction(versions, e).collect()}
    given_up = {x.version_id: (x.failures, x.last_error) for x in queues.abandoned_versions(versions, r, e).collect()}
    last = {v: max((row for row in rows if row[1] == v), default=(0,) * 6)[5] for v in (5, 100)}
    assert pending == {2: 2, 6: 0, 8: 0}
    assert given_up == {5: (4, last[5]), 100: (3, last[100])}


def test_version_history_and_upsert(spark):
    f = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (1, 4, "A"), (2, 1, None), (2, 2, "A")], "resource_id long, seq long, content_hash string")
    assert sorted((r.resource_id, r.version_number, r.seq) for r in latest.version_history(f).collect()) == [(1, 1, 1), (1, 2, 3), (1, 3, 4), (2, 1, 1), (2, 2, 2)]
    old = spark.createDataFrame([(1, "a", "past", "c", "s")], "id long, fullname string, timeline_classification string, created_at string, last_synced_at string")
    batch = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (2, "z", 2)], "id long, fullname string, _seq long")
    once = state.upsert(old, batch, ["id"], "now")
    assert sorted(map(tuple, once.collect())) == [(1, "y", "past", "c", "now"), (2, "z", None, "now", "now")]
    assert sorted(map(tuple, state.upsert(once, batch, ["id"], "now").collect())) == sorted(map(tuple, once.collect()))
    new = spark.range(0, 500).select(F.concat(F.lit("k"), "id").alias("k"))
    made = [{r.k: r.id for r in state.with_ids(spark.createDataFrame([(7,)], "id long"), new.repartition(n), ["k"]).collect()} for n in (1, 3)]
    assert made[0] == made[1] and sorted(made[0].values()) == list(range(8, 508))
    assert state.with_ids(new.limit(0).select(F.lit(1).alias("id")), new.limit(1), ["k"]).first().id == 1


def test_history(spark):
    e = schema.empty(spark, "executions")
    assert history.checkpoint(e, "x", "interval").first().since is None and history.last_successful_start(e, "x").count() == 0
    row = lambda i, status, at, end: (i, "x", "t", 1, status, at, end, 1.0, 1, None, None)
    e = spark.createDataFrame([row(1, "done", "1970-01-01T00:01:00+00:00", "1970"), row(2, "failed", "2024-01-01T00:00:00+00:00", "2024-01-01T00:10:00")], schema.schema("executions"))
    assert history.checkpoint(e, "x", "interval").first().since == 0
    r = spark.createDataFrame([(1, "x", "2024-01-01T00:10:00"), (2, "x", "2024-01-01T00:11:00")], "id long, job_name string, requested_at string")
    assert [x.id for x in history.served_requests(r, e).collect()] == [1]
    assert len(schema.COLUMNS) == 19 and set(schema.PURGED) | set(schema.KEPT) == set(schema.COLUMNS) and not set(schema.PURGED) & set(schema.KEPT)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from quadrivo.sources.warehouse import Warehouse

    w = Warehouse(spark, f"file://{tmp_path}/w")
    w.commit({n: schema.empty(spark, n) for n in ("assignments", "submissions", "resources", "versions", "extractions", "calendar", "courses")})
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pending = plan(read_model.pending_assignments(w["assignments"], w["submissions"], N))
    assert f"GreaterThanOrEqual(duedate,{N})" in pending and "IsNotNull(submission_status)" in pending and "created_at" not in pending
    assert f"LessThanOrEqual(timestart,{N + 5})" in plan(read_model.calendar(w["calendar"], N, N + 5).select("id"))
    assert "EqualTo(timeline_classification,inprogress)" in plan(read_model.current_courses(w["courses"]))
    one_course = plan(read_model.materials(w["resources"], w["versions"], w["extractions"], 3))
    assert "EqualTo(course_id,3)" in one_course and "extracted_text" not in one_course and "LeftSemi" in one_course and "WindowGroupLimit" in one_course
    assert "WindowGroupLimit" in plan(queues.pending_extraction(w["versions"], w["extractions"]))

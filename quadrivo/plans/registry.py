"""Every query of the library over the driver's tables, with its oracle in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import instants, rules, text
from ..functions.instants import HOUR
from ..operators import extraction, history, latest, normalize, orders, queues, read_model, reminders, state
from ..sources import platform, schema, warehouse
from ..sources.parts import dealt
from ..sources.scratch import new_path, written
from .lens import CONFIRMED, ORDER_NOW, TASK_NOW, Lens, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RULES = (
    reminders.Rule("24h", 24 * HOUR, "Entrega: {assignment}", "{course} vence {due_date} a las {due_time} ({tz}), en {remaining}"),
    reminders.Rule("12h", 12 * HOUR, "Pronto: {assignment}", "{course}: {due}, quedan {remaining}"),
    reminders.Rule("6h", 6 * HOUR, "{{hoy}} {assignment}", "{remaining} para {assignment} {course}"),
    reminders.Rule("1h", HOUR, "Ultima hora", "{assignment} ({remaining})"),
)
_RULES_SQL = "(SELECT '24h' AS id, CAST(86400 AS BIGINT) AS o UNION ALL SELECT '12h', 43200 UNION ALL SELECT '6h', 21600 UNION ALL SELECT '1h', 3600)"
_COURSE = "id, shortname, fullname, category, coalesce(timeline_classification = 'inprogress', false) AS is_current, timeline_classification, progress, startdate, enddate, last_synced_at"
_PENDING = "duedate IS NOT NULL AND duedate <> 0 AND duedate >= {now} AND submission_status IS NOT NULL AND submission_status <> 'submitted'"
_ASSIGNMENT = f"a.id, a.course_id, a.name, a.duedate, a.allowsubmissionsfromdate, a.cutoffdate, a.grade, s.submission_status, s.grading_status, CASE WHEN {_PENDING.format(now=ORDER_NOW)} THEN true ELSE false END AS is_pending, a.last_synced_at FROM $assignments a LEFT JOIN $submissions s ON s.assignment_id = a.id"
_LATEST = "(SELECT * FROM $versions v WHERE version_number = (SELECT max(w.version_number) FROM $versions w WHERE w.resource_id = v.resource_id))"
_MATERIAL = f"""SELECT r.id AS resource_id, r.name, r.course_id, r.section_id, r.module_id, r.source_type, r.source_url, v.id AS latest_version_id, v.version_number AS latest_version_number, v.mimetype, v.size_bytes, v.ingested_at, e.status AS extraction_status, e.extractor_name, e.extracted_at
    FROM $resources r LEFT JOIN {_LATEST} v ON v.resource_id = r.id LEFT JOIN (SELECT * FROM $extractions QUALIFY row_number() OVER (PARTITION BY resource_version_id ORDER BY id DESC) = 1) e ON e.resource_version_id = v.id"""
_SETTLED = "EXISTS (SELECT 1 FROM $extractions d WHERE d.resource_version_id = v.id AND d.depth = 'basic' AND (d.status = 'done' OR d.extractor_name = 'unsupported'))"
_FAILED = "(SELECT resource_version_id, count(*) AS n, max(extracted_at) AS at, arg_max_null(error_reason, id) AS why FROM $extractions WHERE depth = 'basic' AND status = 'failed' GROUP BY 1)"
_ABANDONED = f"SELECT v.id AS version_id, v.size_bytes, v.mimetype, r.name, r.course_id, f.n AS failures, f.at AS last_attempt_at, f.why AS last_error FROM {_LATEST} v JOIN $resources r ON r.id = v.resource_id JOIN {_FAILED} f ON f.resource_version_id = v.id WHERE NOT {_SETTLED} AND f.n >= 2"
_NEWEST = "(SELECT course_id, max(last_synced_at) AS newest FROM $sections GROUP BY 1)"
_FILES = f"""SELECT 'moodle' AS origin, 'file' AS source_type, f.fileurl AS external_reference, m.course_id, m.section_id, f.module_id, f.filename AS name, f.fileurl AS source_url, f.mimetype, f.timemodified AS source_timemodified
    FROM $files f JOIN $modules m ON m.id = f.module_id JOIN {_NEWEST} n ON n.course_id = m.course_id WHERE NOT f.last_synced_at < n.newest"""
_URLS = f"""SELECT 'moodle' AS origin, 'url' AS source_type, CAST(m.id AS VARCHAR) AS external_reference, m.course_id, m.section_id, m.id AS module_id, CASE WHEN m.name <> '' THEN m.name ELSE m.url END AS name, m.url AS source_url, CAST(NULL AS VARCHAR) AS mimetype, CAST(NULL AS BIGINT) AS source_timemodified
    FROM $modules m JOIN {_NEWEST} n ON n.course_id = m.course_id WHERE m.modname = 'url' AND m.url <> '' AND NOT m.last_synced_at < n.newest"""
_PENDING_WORK = f"""SELECT d.*, CASE WHEN r.id IS NULL THEN 0 WHEN v.id IS NULL THEN 2 ELSE 1 END AS work_group, coalesce(r.last_synced_at, '') AS second_key, v.id AS latest_version_id
    FROM ({_FILES} UNION ALL {_URLS}) d LEFT JOIN $resources r ON r.origin = d.origin AND r.source_type = d.source_type AND r.external_reference = d.external_reference
    LEFT JOIN {_LATEST} v ON v.resource_id = r.id LEFT JOIN $checks c ON c.resource_id = r.id LEFT JOIN $deferrals f ON f.resource_id = r.id
    WHERE r.id IS NULL OR (v.id IS NULL AND NOT (f.resource_id IS NOT NULL AND f.source_timemodified IS NOT DISTINCT FROM d.source_timemodified))
       OR (v.id IS NOT NULL AND CASE WHEN d.source_type = 'url' THEN sha256(d.source_url) <> v.content_hash ELSE c.resource_id IS NULL OR c.source_timemodified IS DISTINCT FROM d.source_timemodified END)"""
_BANDED = f"(SELECT t.*, (SELECT arg_min(r.id, r.o) FROM {_RULES_SQL} r WHERE r.o >= t.duedate - {TASK_NOW}) AS rule_id FROM $tasks t)"
_CANDIDATES = f"""SELECT t.id AS assignment_id, t.course_id, t.name, t.duedate, t.rule_id, t.duedate - {TASK_NOW} AS remaining_seconds, 'assignment_due_' || t.rule_id AS notification_type, 'assignment:' || CAST(t.id AS VARCHAR) AS subject_key, ISO(t.duedate) AS scheduled_for
    FROM {_BANDED} t JOIN $task_status s ON s.assignment_id = t.id WHERE t.rule_id IS NOT NULL AND t.last_synced_at >= '{CONFIRMED}' AND {_PENDING.format(now=TASK_NOW)}"""
_UNSENT = f"SELECT * FROM ({_CANDIDATES}) c WHERE NOT EXISTS (SELECT 1 FROM $sent x WHERE x.notification_type = c.notification_type AND x.subject_key = c.subject_key AND x.scheduled_for = c.scheduled_for)"
_WORDS = """CASE WHEN {s} < 60 THEN 'menos de un minuto' WHEN {s} < 3600 THEN CAST({s} // 60 AS VARCHAR) || CASE WHEN {s} // 60 = 1 THEN ' minuto' ELSE ' minutos' END
    WHEN {s} < 86400 THEN CAST({s} // 3600 AS VARCHAR) || CASE WHEN {s} // 3600 = 1 THEN ' hora' ELSE ' horas' END ELSE CAST({s} // 86400 AS VARCHAR) || CASE WHEN {s} // 86400 = 1 THEN ' dia' ELSE ' dias' END END"""


def query(name: str, oracle: str | None = None):
    """Registers a function of Lens as a query; oracle is over $tables."""

    def add(f: Callable[[Lens], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Lens(spark, sf_dir))
        if oracle is not None:
            ORACLE_SQL[name] = duckdb_sql(oracle)
        return f

    return add


# --- read model -------------------------------------------------------------------------------------

query("course_summary", f"SELECT {_COURSE} FROM $courses")(lambda t: read_model.courses(t["courses"]))
query("current_courses", f"SELECT {_COURSE} FROM $courses WHERE timeline_classification = 'inprogress'")(lambda t: read_model.current_courses(t["courses"]))
query("course_by_id", f"SELECT {_COURSE} FROM $courses WHERE id = 42")(lambda t: read_model.by_id(read_model.courses(t["courses"]), 42))
query("assignments_with_status", f"SELECT {_ASSIGNMENT}")(lambda t: read_model.assignments(t["assignments"], t["submissions"], ORDER_NOW))
query("assignments_of_course", f"SELECT {_ASSIGNMENT} WHERE a.course_id = 7")(lambda t: read_model.assignments(t["assignments"], t["submissions"], ORDER_NOW, 7))
query("pending_assignments", f"SELECT {_ASSIGNMENT} WHERE {_PENDING.format(now=ORDER_NOW)}")(lambda t: read_model.pending_assignments(t["assignments"], t["submissions"], ORDER_NOW))
query("upcoming_assignments", f"SELECT {_ASSIGNMENT} WHERE a.duedate <> 0 AND a.duedate BETWEEN {ORDER_NOW} AND {ORDER_NOW + 30 * 86400}")(lambda t: read_model.upcoming_assignments(t["assignments"], t["submissions"], ORDER_NOW, 30))
query("calendar_range", f"SELECT * FROM $calendar WHERE timestart >= {TASK_NOW} AND timestart <= {TASK_NOW + 3 * 86400}")(lambda t: read_model.calendar(t["calendar"], TASK_NOW, TASK_NOW + 3 * 86400))
query("course_calendar_range", f"SELECT * FROM $calendar WHERE course_id = 5 AND timestart BETWEEN {TASK_NOW - 9 * 86400} AND {TASK_NOW + 9 * 86400}")(lambda t: read_model.calendar(t["calendar"], TASK_NOW - 9 * 86400, TASK_NOW + 9 * 86400, 5))
query("grades_all", "SELECT * FROM $grades")(lambda t: t["grades"])
query("grades_by_course", "SELECT * FROM $grades WHERE course_id = 10")(lambda t: read_model.of_course(t.grades_of(10), 10))
query("course_materials", f"{_MATERIAL} WHERE r.course_id = 4")(lambda t: read_model.materials(t["resources"], t["versions"], t["extractions"], 4))
query("materials_all", _MATERIAL)(lambda t: read_model.materials(t["resources"], t["versions"], t["extractions"]))
query("material_by_id", f"{_MATERIAL} WHERE r.id = 19")(lambda t: read_model.materials(t["resources"], t["versions"], t["extractions"], resource=19))
query("course_has_contents", "SELECT * FROM $courses c WHERE EXISTS (SELECT 1 FROM $sections s WHERE s.course_id = c.id)")(lambda t: read_model.has_contents(t["courses"], t["sections"]))

# --- orders -----------------------------------------------------------------------------------------


def _ordered(name: str, rows: Callable[[Lens], DataFrame], sql: str, order: list[tuple[str, str]], key: str) -> None:
    """A query of all rows in their order: as result sets are compared without one, each row says which stands before it."""
    words = ", ".join(f"{c} {how}" for c, how in order)
    query(name, f"SELECT *, lag({key}) OVER (ORDER BY {words}) AS after FROM ({sql}) o")(
        lambda t: orders.with_previous(rows(t), [F.desc_nulls_last(c) if how.startswith("DESC") else F.asc_nulls_first(c) for c, how in order], key, "after")
    )


_NULLS_FIRST, _NULLS_LAST = "ASC NULLS FIRST", "DESC NULLS LAST"
_ordered("courses_ordered", lambda t: read_model.courses(t["courses"]), f"SELECT {_COURSE} FROM $courses", [("fullname", _NULLS_FIRST), ("id", _NULLS_FIRST)], "id")
_ordered("assignments_by_duedate", lambda t: read_model.assignments(t["assignments"], t["submissions"], ORDER_NOW), f"SELECT {_ASSIGNMENT}", [("duedate", _NULLS_FIRST), ("id", _NULLS_FIRST)], "id")
_ordered("grades_ordered", lambda t: t["grades"], "SELECT * FROM $grades", [("course_id", _NULLS_FIRST), ("item_name", _NULLS_FIRST), ("id", _NULLS_FIRST)], "id")
_ordered("calendar_ordered", lambda t: t["calendar"], "SELECT * FROM $calendar", [("timestart", _NULLS_FIRST), ("id", _NULLS_FIRST)], "id")
_ordered("modules_ordered", lambda t: t["modules"], "SELECT * FROM $modules", [("course_id", _NULLS_FIRST), ("section_id", _NULLS_FIRST), ("id", _NULLS_FIRST)], "id")
_ordered("materials_ordered", lambda t: read_model.materials(t["resources"], t["versions"], t["extractions"]), _MATERIAL, [("name", _NULLS_FIRST), ("resource_id", _NULLS_FIRST)], "resource_id")
_ordered("abandoned_ordered", lambda t: queues.abandoned_versions(t["versions"], t["resources"], t["extractions"], most=2), _ABANDONED, [("failures", _NULLS_LAST), ("version_id", _NULLS_FIRST)], "version_id")
_ordered("deferrals_biggest", lambda t: queues.listed_deferrals(t["deferrals"], t["resources"]).select("resource_id", "name", "size_bytes", F.expr("size_bytes div 1048576").alias("mb"), F.expr("limit_bytes div 1048576").alias("limit_mb"), "deferred_at"),
         "SELECT d.resource_id, r.name, d.size_bytes, d.size_bytes // 1048576 AS mb, d.limit_bytes // 1048576 AS limit_mb, d.deferred_at FROM $deferrals d JOIN $resources r ON r.id = d.resource_id", [("size_bytes", _NULLS_LAST), ("resource_id", _NULLS_FIRST)], "resource_id")

# --- latest of a key --------------------------------------------------------------------------------

query("latest_version", f"SELECT * FROM {_LATEST} x")(lambda t: latest.latest_versions(t["versions"]))
query("latest_extraction_any_depth", "SELECT * FROM $extractions QUALIFY row_number() OVER (PARTITION BY resource_version_id ORDER BY id DESC) = 1")(lambda t: latest.latest_extractions(t["extractions"]))
query("latest_extraction_at_depth", "SELECT * FROM $extractions WHERE depth = 'deep' QUALIFY row_number() OVER (PARTITION BY resource_version_id ORDER BY id DESC) = 1")(lambda t: latest.latest_extractions(t["extractions"], "deep"))
query("next_version_number", "SELECT r.id, coalesce(max(v.version_number), 0) + 1 AS next_number FROM $resources r LEFT JOIN $versions v ON v.resource_id = r.id GROUP BY r.id")(lambda t: latest.next_version_numbers(t["resources"], t["versions"]))
query(
    "version_history_from_hashes",
    """WITH f AS (SELECT source AS resource_id, doc_id AS seq, sha256(CAST(n_chars % 3 AS VARCHAR)) AS content_hash FROM $documents), c AS (SELECT *, content_hash IS DISTINCT FROM lag(content_hash) OVER (PARTITION BY resource_id ORDER BY seq) AS fresh FROM f)
    SELECT resource_id, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY resource_id ORDER BY seq) AS BIGINT) AS version_number, seq, content_hash FROM c QUALIFY fresh""",
)(lambda t: latest.version_history(t["documents"].select(F.col("source").alias("resource_id"), F.col("doc_id").alias("seq"), F.sha2((F.col("n_chars") % 3).cast("string"), 256).alias("content_hash"))))
query("extraction_attempts", "SELECT id, resource_version_id, depth, status, row_number() OVER (PARTITION BY resource_version_id ORDER BY id) AS nth FROM $extractions")(
    lambda t: t["extractions"].select("id", "resource_version_id", "depth", "status", F.expr("row_number() OVER (PARTITION BY resource_version_id ORDER BY id)").cast("bigint").alias("nth"))
)
query("versions_of_resource", "SELECT * FROM $versions WHERE resource_id = 19")(lambda t: read_model.by_id(t["versions"], 19, "resource_id"))

# --- work queues ------------------------------------------------------------------------------------

query("pending_extraction", f"SELECT v.id, coalesce(f.n, 0) AS failed_count FROM {_LATEST} v LEFT JOIN {_FAILED} f ON f.resource_version_id = v.id WHERE NOT {_SETTLED} AND coalesce(f.n, 0) < 3")(lambda t: queues.pending_extraction(t["versions"], t["extractions"]))
query(
    "abandoned_versions",
    _ABANDONED,
)(lambda t: queues.abandoned_versions(t["versions"], t["resources"], t["extractions"], most=2))
query("budget_topk", f"SELECT v.id, coalesce(f.n, 0) AS failed_count FROM {_LATEST} v LEFT JOIN {_FAILED} f ON f.resource_version_id = v.id WHERE NOT {_SETTLED} AND coalesce(f.n, 0) < 3 ORDER BY failed_count, id LIMIT {queues.EXTRACTION_BUDGET}")(
    lambda t: queues.budget(queues.pending_extraction(t["versions"], t["extractions"]), ["failed_count", "id"], queues.EXTRACTION_BUDGET)
)
query("current_row_filter", f"SELECT m.* FROM $modules m JOIN {_NEWEST} n ON n.course_id = m.course_id WHERE NOT m.last_synced_at < n.newest")(lambda t: queues.current_rows(t["modules"], t["sections"]))
query("file_descriptors", _FILES)(lambda t: queues.file_descriptors(t["files"], t["modules"], t["sections"]))
query("url_descriptors", _URLS)(lambda t: queues.url_descriptors(t["modules"], t["sections"]))
query("descriptors_union", f"{_FILES} UNION ALL {_URLS}")(lambda t: queues.descriptors(t["files"], t["modules"], t["sections"]))


def _pending_work(t: Lens) -> DataFrame:
    return queues.ingestion_pending(queues.descriptors(t["files"], t["modules"], t["sections"]), t["resources"], t["versions"], t["checks"], t["deferrals"])


query("ingestion_pending", _PENDING_WORK)(_pending_work)
query("ingestion_pending_ordered", f"SELECT * FROM ({_PENDING_WORK}) w ORDER BY work_group, second_key, external_reference LIMIT {queues.INGESTION_BUDGET}")(lambda t: queues.budget(_pending_work(t), ["work_group", "second_key", "external_reference"], queues.INGESTION_BUDGET))
query("ingestion_deferrals", "SELECT d.resource_id, d.reason, d.size_bytes, d.limit_bytes, d.deferred_at, r.name, r.course_id FROM $deferrals d JOIN $resources r ON r.id = d.resource_id")(lambda t: queues.listed_deferrals(t["deferrals"], t["resources"]))
_NEEDS = f"SELECT a.id FROM $assignments a LEFT JOIN $submissions s ON s.assignment_id = a.id WHERE s.assignment_id IS NULL OR (a.duedate > {ORDER_NOW} AND (s.submission_status IS NULL OR s.submission_status <> 'submitted'))"
_UPDATES = "(SELECT id AS course_id, CASE WHEN id % 6 = 0 THEN 2 ELSE 0 END AS i, CASE WHEN id % 15 = 0 THEN 1 ELSE 0 END AS w FROM $courses WHERE id % 2 = 0)"
_CHANGED = f"SELECT c.id FROM $courses c WHERE NOT EXISTS (SELECT 1 FROM $sections s WHERE s.course_id = c.id) OR EXISTS (SELECT 1 FROM {_UPDATES} u WHERE u.course_id = c.id AND u.i + u.w > 0)"


def _changed(t: Lens) -> DataFrame:
    updates = t["courses"].filter("id % 2 = 0").select(F.col("id").alias("course_id"), F.expr("CASE WHEN id % 6 = 0 THEN 2 ELSE 0 END").alias("n_instances"), F.expr("CASE WHEN id % 15 = 0 THEN 1 ELSE 0 END").alias("n_warnings"))
    return queues.changed_courses(t["courses"], t["sections"], updates, False)


query("assignments_needing_status", _NEEDS)(lambda t: queues.needs_status(t["assignments"], t["submissions"], ORDER_NOW))
query("changed_courses", _CHANGED)(_changed)
query("changed_courses_full", "SELECT id FROM $courses")(lambda t: queues.changed_courses(t["courses"], t["sections"], t["courses"].limit(0), True))
query("status_refresh_ids", f"SELECT DISTINCT id FROM (SELECT a.id FROM $assignments a WHERE a.id % 3 <> 0 AND a.course_id IN ({_CHANGED}) UNION ALL SELECT n.id FROM ({_NEEDS}) n WHERE n.id % 3 <> 0) x")(
    lambda t: queues.status_refresh(t["assignments"].filter("id % 3 <> 0"), _changed(t), queues.needs_status(t["assignments"], t["submissions"], ORDER_NOW))
)
query("timeline_labels", "SELECT id, CASE WHEN id % 5 = 0 THEN 'future' WHEN id % 3 = 0 THEN 'past' ELSE 'inprogress' END AS timeline_classification FROM $courses WHERE id % 2 = 0 OR id % 3 = 0 OR id % 5 = 0")(
    lambda t: queues.labelled_timeline(*(t["courses"].filter(f"id % {n} = 0") for n in (2, 3, 5)))
)
query("candidate_assignment_ids", f"SELECT DISTINCT assignment_id FROM ({_CANDIDATES}) c")(lambda t: _candidates(t).select("assignment_id").distinct())

# --- reminders --------------------------------------------------------------------------------------


def _rules(t: Lens) -> DataFrame:
    return reminders.rule_table(t.spark, RULES)


def _candidates(t: Lens) -> DataFrame:
    return reminders.candidates(t["tasks"], t["task_status"], _rules(t), TASK_NOW, CONFIRMED)


query("reminder_bands", f"SELECT id, duedate, rule_id FROM {_BANDED} t WHERE rule_id IS NOT NULL AND duedate >= {TASK_NOW}")(lambda t: reminders.in_band(t["tasks"].filter(F.col("duedate") >= TASK_NOW), _rules(t), TASK_NOW).select("id", "duedate", "rule_id"))
_EDGES = "(SELECT set_id, id, coalesce(lag(offset_seconds) OVER (PARTITION BY set_id ORDER BY offset_seconds, id), 0) AS lower, offset_seconds AS upper FROM {rules} r)"
query("reminder_band_edges", f"SELECT * FROM {_EDGES.format(rules='$rule_sets')} e")(lambda t: reminders.bands(t["rule_sets"], "set_id"))
query("narrowest_band", f"SELECT set_id, CAST(min(upper - lower) AS BIGINT) AS narrowest FROM {_EDGES.format(rules='$rule_sets')} e GROUP BY set_id")(lambda t: reminders.narrowest_band(t["rule_sets"], "set_id"))
query("reminder_bands_by_set", f"SELECT t.id, t.duedate, t.course_id AS set_id, arg_min(r.id, r.offset_seconds) AS rule_id FROM $tasks t JOIN $rule_sets r ON r.set_id = t.course_id AND r.offset_seconds >= t.duedate - {TASK_NOW} GROUP BY ALL")(
    lambda t: reminders.in_band(t["tasks"].select("id", "duedate", F.col("course_id").alias("set_id")), t["rule_sets"], TASK_NOW, by="set_id").select("id", "duedate", "set_id", "rule_id")
)
_VIOLATIONS = f"""(SELECT set_id, id AS rule_id, 'duplicate id' AS problem FROM $rule_drafts GROUP BY set_id, id HAVING count(*) > 1 UNION ALL SELECT set_id, min(id), 'duplicate offset' FROM $rule_drafts GROUP BY set_id, offset_seconds HAVING count(*) > 1
    UNION ALL SELECT set_id, id, 'not before the deadline' FROM $rule_drafts WHERE offset_seconds <= 0 UNION ALL SELECT set_id, id, 'band too narrow' FROM {_EDGES.format(rules='$rule_drafts')} e WHERE upper - lower BETWEEN 1 AND 3599)"""
query("rule_validation", f"SELECT * FROM {_VIOLATIONS} v")(lambda t: reminders.violations(t["rule_drafts"], "set_id"))
_HOST = "(SELECT set_id, id, offset_seconds FROM $rule_drafts WHERE offset_seconds > 36000)"


def _effective(t: Lens, saved: DataFrame) -> DataFrame:
    return reminders.effective_rules(t["rule_drafts"].filter("offset_seconds > 36000"), t["rule_sets"], saved, "set_id").select("set_id", "id", "offset_seconds")


query("effective_rules_never_saved", f"SELECT * FROM {_HOST} h")(lambda t: _effective(t, t["rule_marks"].filter("set_id < 0")))
query("effective_rules_saved", f"SELECT set_id, id, offset_seconds FROM $rule_sets WHERE enabled AND set_id IN (SELECT set_id FROM $rule_marks) UNION ALL SELECT * FROM {_HOST} h WHERE set_id NOT IN (SELECT set_id FROM $rule_marks)")(lambda t: _effective(t, t["rule_marks"]))
query("reminder_candidates", _CANDIDATES)(lambda t: _candidates(t).drop("title_template", "body_template"))
query("reminder_unsent", _UNSENT)(lambda t: reminders.unsent(_candidates(t), t["sent"]).drop("title_template", "body_template"))
query("reminders_without_sync", "SELECT CAST(1 AS BIGINT) AS assignment_id WHERE false")(lambda t: reminders.candidates(t["tasks"], t["task_status"], _rules(t), TASK_NOW, None).select("assignment_id"))
_LOCAL = "make_timestamp((u.duedate - 14400) * 1000000)"
_NAMES = "coalesce(c.fullname, 'Curso ' || CAST(u.course_id AS VARCHAR))"
_LEFT_WORDS = _WORDS.format(s="u.remaining_seconds")
query(
    "reminder_messages",
    f"""SELECT u.notification_type, u.subject_key, u.scheduled_for, CASE u.rule_id WHEN '24h' THEN 'Entrega: ' || u.name WHEN '12h' THEN 'Pronto: ' || u.name WHEN '6h' THEN '{{hoy}} ' || u.name ELSE 'Ultima hora' END AS title,
    CASE u.rule_id WHEN '24h' THEN {_NAMES} || ' vence ' || strftime({_LOCAL}, '%Y-%m-%d') || ' a las ' || strftime({_LOCAL}, '%H:%M') || ' (America/Santo_Domingo), en ' || {_LEFT_WORDS}
    WHEN '12h' THEN {_NAMES} || ': ' || strftime({_LOCAL}, '%Y-%m-%d %H:%M') || ', quedan ' || {_LEFT_WORDS} WHEN '6h' THEN {_LEFT_WORDS} || ' para ' || u.name || ' ' || {_NAMES} ELSE u.name || ' (' || {_LEFT_WORDS} || ')' END AS body
    FROM ({_UNSENT}) u LEFT JOIN $courses c ON c.id = u.course_id""",
)(lambda t: reminders.messages(reminders.unsent(_candidates(t), t["sent"]), t["courses"], RULES))
query("remaining_words", f"SELECT id, {_WORDS.format(s='(duedate - 1704067200)')} AS words FROM $tasks")(lambda t: t["tasks"].select("id", instants.remaining_words(F.col("duedate") - 1_704_067_200).alias("words")))
query("subject_key_roundtrip", "SELECT id, 'assignment:' || CAST(id AS VARCHAR) AS k, id AS back, CAST(NULL AS BIGINT) AS other FROM $tasks")(
    lambda t: t["tasks"].select("id", text.subject_key("id").alias("k"), text.subject_id(text.subject_key("id")).alias("back"), text.subject_id(F.concat(F.lit("job:"), F.col("id").cast("string"))).alias("other"))
)
query("message_truncation", "SELECT doc_id, CASE WHEN length(source || chr(10) || text) > 4096 THEN left(source || chr(10) || text, 4095) || '…' ELSE source || chr(10) || text END AS message FROM $documents")(lambda t: t["documents"].select("doc_id", text.message("source", "text").alias("message")))

# --- clock, history, operation ----------------------------------------------------------------------

query("next_aligned_grid", "SELECT id, (((timestart - 14400) // 21600) + 1) * 21600 + 14400 AS next_slot, (timestart // 3600 + 1) * 3600 AS next_hour FROM $calendar")(
    lambda t: t["calendar"].select("id", instants.next_slot("timestart", 6).cast("bigint").alias("next_slot"), instants.next_slot("timestart", 1).cast("bigint").alias("next_hour"))
)
query("local_iso", "SELECT id, strftime(make_timestamp((timestart - 14400) * 1000000), '%Y-%m-%dT%H:%M:%S-04:00') AS at FROM $calendar")(lambda t: t["calendar"].select("id", F.date_format(instants.local("timestart"), "yyyy-MM-dd'T'HH:mm:ss'-04:00'").alias("at")))
query("last_execution_per_job", "SELECT * FROM $executions QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY id DESC) = 1")(lambda t: history.last_execution(t["executions"]))
query("last_failure_per_job", "SELECT * FROM $executions WHERE status = 'failed' QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY id DESC) = 1")(lambda t: history.last_execution(t["executions"], "failed"))
query("last_successful_sync", "SELECT started_at FROM $executions WHERE job_name = 'view' AND status = 'done' ORDER BY id DESC LIMIT 1")(lambda t: history.last_successful_start(t["executions"], "view"))
query("sync_checkpoint", "SELECT greatest(0, CAST(epoch(CAST(left(started_at, 19) AS TIMESTAMP)) AS BIGINT) - 300) AS since FROM $executions WHERE job_name = 'view' AND status = 'done' ORDER BY id DESC LIMIT 1")(lambda t: history.checkpoint(t["executions"], "view", "interval"))
query("sync_checkpoint_startup", "SELECT CAST(NULL AS BIGINT) AS since")(lambda t: history.checkpoint(t["executions"], "view", "startup"))
query("recent_executions", "SELECT * FROM $executions ORDER BY id DESC LIMIT 10")(lambda t: history.recent_executions(t["executions"]))
query("running_executions", "SELECT * FROM $executions WHERE status = 'running'")(lambda t: history.running(t["executions"]))
query("request_served", "SELECT * FROM $requests r WHERE EXISTS (SELECT 1 FROM $executions e WHERE e.job_name = r.job_name AND (e.finished_at IS NULL OR e.finished_at >= r.requested_at))")(lambda t: history.served_requests(t["requests"], t["executions"]))
query("stale_running_failed", "SELECT * REPLACE (CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'now' ELSE finished_at END AS finished_at, CASE WHEN status = 'running' THEN 'gone' ELSE error END AS error) FROM $executions")(
    lambda t: state.fail_stale_running(t["executions"], "now", "gone")
)
query("finish_execution", "SELECT * REPLACE (CASE WHEN id = 7 THEN 'done' ELSE status END AS status, CASE WHEN id = 7 THEN 'now' ELSE finished_at END AS finished_at, CASE WHEN id = 7 THEN 1.5 ELSE duration_seconds END AS duration_seconds, CASE WHEN id = 7 THEN 3 ELSE items_processed END AS items_processed, CASE WHEN id = 7 THEN 'ok' ELSE detail END AS detail, CASE WHEN id = 7 THEN NULL ELSE error END AS error) FROM $executions")(
    lambda t: state.finish_execution(t["executions"], 7, "done", "now", 1.5, 3, "ok")
)
query("execution_error_redacted", "SELECT id, 'URLError: wstoken=***&x=1' AS error FROM $executions WHERE error IS NOT NULL")(lambda t: t["executions"].filter("error IS NOT NULL").select("id", text.redact("error").alias("error")))
_COUNTED = ("courses", "sections", "modules", "files", "assignments", "submissions", "grades", "calendar", "resources", "versions", "extractions", "checks", "deferrals", "users")
query("purge_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM ${n}" for n in _COUNTED))(lambda t: history.table_counts({n: t[n] for n in _COUNTED}))
query("sync_totals", "SELECT CAST(count(*) + 3 * count(*) AS BIGINT) AS items_processed, 'incremental: 2/' || count(*) || ' course(s) re-synced, ' || count(*) || ' assignment(s), ' || count(*) || ' status(es), ' || count(*) || ' grade item(s), 0 event(s), 1 item warning(s)' AS summary FROM $courses")(
    lambda t: history.sync_totals(t["courses"].agg(F.count("*").alias("courses")).selectExpr("courses", "2L AS changed", "courses AS assignments", "courses AS statuses", "courses AS grades", "0L AS events", "0L AS detection_warnings", "1L AS item_warnings", "false AS full"))
)
query("batch_counters", "SELECT count(*) AS attempted, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, CAST(0 AS BIGINT) AS deferred, arg_min(error_reason, id) FILTER (error_reason IS NOT NULL) AS first_error FROM $extractions")(
    lambda t: history.batch_counters(t["extractions"].select(F.col("id").alias("seq"), F.col("status").alias("outcome"), F.col("error_reason").alias("error")))
)
query("op_extractor_method_counts", "SELECT extractor_name, json_extract_string(metadata, '$.method') AS method, count(*) AS n FROM $extractions WHERE status = 'done' GROUP BY ALL")(lambda t: history.method_counts(t["extractions"]))
query("op_error_reason_counts", "SELECT error_reason, count(*) AS n FROM $extractions WHERE status = 'failed' GROUP BY ALL")(lambda t: history.error_counts(t["extractions"]))
query("op_storage_volume", "SELECT count(*) AS versions, CAST(sum(size_bytes) AS BIGINT) // 1048576 AS mb FROM $versions")(lambda t: history.storage_volume(t["versions"]))
query("suppressed_count", f"SELECT (SELECT count(*) FROM ({_CANDIDATES}) c) - (SELECT count(*) FROM ({_UNSENT}) u) AS suppressed")(
    lambda t: _candidates(t).agg(F.count("*").alias("a")).crossJoin(reminders.unsent(_candidates(t), t["sent"]).agg(F.count("*").alias("b"))).selectExpr("a - b AS suppressed")
)
_LAST = "(SELECT * FROM $executions {w} QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY id DESC) = 1)"
query(
    "status_report",
    f"""SELECT j.job_name, l.status, l.started_at, l.trigger, l.attempt, l.items_processed, l.detail, f.started_at AS failed_at, f.error AS last_error, coalesce(r.n, 0) AS n_running, coalesce(w.n, 0) AS n_waiting
    FROM (SELECT unnest(['view', 'click', 'signup', 'absent']) AS job_name) j LEFT JOIN {_LAST.format(w="")} l ON l.job_name = j.job_name LEFT JOIN {_LAST.format(w="WHERE status = 'failed'")} f ON f.job_name = j.job_name
    LEFT JOIN (SELECT job_name, count(*) AS n FROM $executions WHERE status = 'running' GROUP BY 1) r ON r.job_name = j.job_name LEFT JOIN (SELECT job_name, count(*) AS n FROM $requests GROUP BY 1) w ON w.job_name = j.job_name""",
)(lambda t: history.status_report(t["executions"], t["requests"], ["view", "click", "signup", "absent"]))

# --- mutations --------------------------------------------------------------------------------------

_NOW = "2024-02-01T00:00:00+00:00"
def _logged(t: Lens, *tables: str) -> warehouse.Warehouse:
    """A warehouse of its own that has tables committed."""
    made = warehouse.Warehouse(t.spark, new_path(t.spark, "warehouse"))
    made.commit({name: t[name] for name in tables})
    return made


def _appended(t: Lens, table: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A table after rows were appended to its log, under ids that were set aside."""
    w, rows = _logged(t, table), written(rows, "rows")
    new = state.with_ids(t[table].limit(0), rows, keys, last=w.reserve(table, rows.count()))
    w.commit(append={table: new.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.schema(table) if f.name not in new.columns))})
    return w[table]


def _put(t: Lens, table: str, batch: DataFrame) -> DataFrame:
    """A table after a batch was put over it: only rows of the batch's keys are read and written."""
    w, keys = _logged(t, table), schema.identity(table)
    w.commit(put={table: state.upsert_with_ids(w.find(table, batch), batch, keys, _NOW, reserve=lambda n: w.reserve(table, n))})
    return w[table]


def _begun(t: Lens) -> DataFrame:
    w = _logged(t, "executions")
    w.commit(append={"executions": state.start_execution(schema.empty(t.spark, "executions"), w.reserve("executions", 1) + 1, "ingestion", "manual", 2, "now")})
    return w["executions"]


query(
    "upsert_courses",
    f"""WITH b AS (SELECT id + 5 AS id, 'new ' || fullname AS fullname, shortname, category, visible, progress, startdate, enddate FROM $courses WHERE id % 4 = 0)
    SELECT coalesce(c.id, b.id) AS id, CASE WHEN b.id IS NULL THEN c.shortname ELSE b.shortname END AS shortname, CASE WHEN b.id IS NULL THEN c.fullname ELSE b.fullname END AS fullname, CASE WHEN b.id IS NULL THEN c.category ELSE b.category END AS category,
    CASE WHEN b.id IS NULL THEN c.visible ELSE b.visible END AS visible, CASE WHEN b.id IS NULL THEN c.progress ELSE b.progress END AS progress, CASE WHEN b.id IS NULL THEN c.startdate ELSE b.startdate END AS startdate, CASE WHEN b.id IS NULL THEN c.enddate ELSE b.enddate END AS enddate,
    c.timeline_classification, coalesce(c.created_at, '{_NOW}') AS created_at, CASE WHEN b.id IS NULL THEN c.last_synced_at ELSE '{_NOW}' END AS last_synced_at FROM $courses c FULL JOIN b ON b.id = c.id""",
)(lambda t: state.upsert(t["courses"], t["courses"].filter("id % 4 = 0").selectExpr("id + 5 AS id", "'new ' || fullname AS fullname", "shortname", "category", "visible", "progress", "startdate", "enddate", "1 AS _seq").unionByName(t["courses"].filter("id % 8 = 0").selectExpr("id + 5 AS id", "'lost' AS fullname", "shortname", "category", "visible", "progress", "startdate", "enddate", "0 AS _seq")), ["id"], _NOW))
query(
    "upsert_resources",
    f"""WITH b AS (SELECT origin, source_type, CASE WHEN id % 4 = 0 THEN external_reference ELSE 'n' || external_reference END AS external_reference, course_id, section_id, module_id, name || '!' AS name, source_url FROM $resources WHERE id % 2 = 0),
    f AS (SELECT b.*, (SELECT max(id) FROM $resources) + row_number() OVER (ORDER BY sha256(concat_ws(chr(31), origin, source_type, external_reference))) AS id FROM b WHERE NOT EXISTS (SELECT 1 FROM $resources r WHERE r.origin = b.origin AND r.source_type = b.source_type AND r.external_reference = b.external_reference))
    SELECT r.id, r.origin, r.source_type, r.external_reference, r.course_id, r.section_id, r.module_id, CASE WHEN b.origin IS NULL THEN r.name ELSE b.name END AS name, r.source_url, r.created_at, CASE WHEN b.origin IS NULL THEN r.last_synced_at ELSE '{_NOW}' END AS last_synced_at
    FROM $resources r LEFT JOIN b ON r.origin = b.origin AND r.source_type = b.source_type AND r.external_reference = b.external_reference
    UNION ALL SELECT id, origin, source_type, external_reference, course_id, section_id, module_id, name, source_url, '{_NOW}', '{_NOW}' FROM f""",
)(lambda t: _put(t, "resources", t["resources"].filter("id % 2 = 0").selectExpr("origin", "source_type", "CASE WHEN id % 4 = 0 THEN external_reference ELSE 'n' || external_reference END AS external_reference", "course_id", "section_id", "module_id", "name || '!' AS name", "source_url", "id AS _seq")))
def _upserted(columns: str, key: str) -> str:
    """The oracle of an upsert of the rows with key % 4 = 0, changed in one column, as keys key + 3."""
    first, *rest = columns.split(", ")
    value = lambda c: f"CASE WHEN b.{key} IS NULL THEN o.{c} ELSE b.{c} END AS {c}"
    return f"""WITH b AS (SELECT {key} + 3 AS {key}, concat({first}, '!') AS {first}, {", ".join(rest)} FROM $TABLE WHERE {key} % 4 = 0)
        SELECT coalesce(o.{key}, b.{key}) AS {key}, {", ".join(map(value, [first, *rest]))}, coalesce(o.created_at, '{_NOW}') AS created_at, CASE WHEN b.{key} IS NULL THEN o.last_synced_at ELSE '{_NOW}' END AS last_synced_at FROM $TABLE o FULL JOIN b ON b.{key} = o.{key}"""


for _table, _key, _columns in (
    ("users", "id", "fullname, username"),
    ("sections", "id", "name, course_id, section_number, summary, visible"),
    ("modules", "id", "modname, course_id, section_id, name, url, visible"),
    ("assignments", "id", "name, course_id, duedate, allowsubmissionsfromdate, cutoffdate, grade"),
    ("submissions", "assignment_id", "grading_status, submission_status, cansubmit, submitted_at"),
    ("grades", "id", "item_type, course_id, user_id, cmid, item_name, item_module, grade_raw, grade_formatted, percentage_formatted"),
    ("calendar", "id", "name, course_id, description, eventtype, modulename, instance, timestart, timesort, timeduration"),
):
    query(f"upsert_{_table}", _upserted(_columns, _key).replace("$TABLE", f"${_table}"))(
        lambda t, n=_table, k=_key, c=_columns.split(", "): state.upsert(t[n], t[n].filter(f"{k} % 4 = 0").select((F.col(k) + 3).alias(k), F.concat(c[0], F.lit("!")).alias(c[0]), *c[1:], F.col(k).alias("_seq")), [k], _NOW)
    )
query(
    "upsert_files",
    f"""WITH b AS (SELECT module_id, filename, filepath, filesize + 1 AS filesize, mimetype, CASE WHEN id % 4 = 0 THEN fileurl ELSE 'n' || fileurl END AS fileurl, timemodified FROM $files WHERE id % 2 = 0),
    f AS (SELECT b.*, (SELECT max(id) FROM $files) + row_number() OVER (ORDER BY sha256(fileurl)) AS id FROM b WHERE fileurl NOT IN (SELECT fileurl FROM $files))
    SELECT o.id, o.module_id, o.filename, o.filepath, CASE WHEN b.fileurl IS NULL THEN o.filesize ELSE b.filesize END AS filesize, o.mimetype, o.fileurl, o.timemodified, o.created_at, CASE WHEN b.fileurl IS NULL THEN o.last_synced_at ELSE '{_NOW}' END AS last_synced_at FROM $files o LEFT JOIN b ON b.fileurl = o.fileurl
    UNION ALL SELECT id, module_id, filename, filepath, filesize, mimetype, fileurl, timemodified, '{_NOW}', '{_NOW}' FROM f""",
)(lambda t: state.upsert_with_ids(t["files"], t["files"].filter("id % 2 = 0").selectExpr("module_id", "filename", "filepath", "filesize + 1 AS filesize", "mimetype", "CASE WHEN id % 4 = 0 THEN fileurl ELSE 'n' || fileurl END AS fileurl", "timemodified", "id AS _seq"), ["fileurl"], _NOW))
query("append_versions", "SELECT id, resource_id, version_number FROM $versions UNION ALL SELECT (SELECT max(id) FROM $versions) + row_number() OVER (ORDER BY sha256(CAST(r.id AS VARCHAR))), r.id, coalesce(max(v.version_number), 0) + 1 FROM $resources r LEFT JOIN $versions v ON v.resource_id = r.id WHERE r.id % 10 = 1 GROUP BY r.id")(
    lambda t: _appended(t, "versions", latest.next_version_numbers(t["resources"].filter("id % 10 = 1"), t["versions"]).select(F.col("id").alias("resource_id"), F.col("next_number").alias("version_number")), ["resource_id"]).select("id", "resource_id", "version_number")
)
query("upsert_checks", "SELECT coalesce(b.resource_id, c.resource_id) AS resource_id, CASE WHEN b.resource_id IS NULL THEN c.source_timemodified ELSE 1 END AS source_timemodified, CASE WHEN b.resource_id IS NULL THEN c.checked_at ELSE 'now' END AS checked_at FROM $checks c FULL JOIN (SELECT id AS resource_id FROM $resources WHERE id % 5 = 0 OR id % 7 = 0) b ON b.resource_id = c.resource_id")(
    lambda t: state.upsert(t["checks"], t["resources"].filter("id % 5 = 0 OR id % 7 = 0").selectExpr("id AS resource_id", "1L AS source_timemodified", "'now' AS checked_at", "id AS _seq"), ["resource_id"], _NOW)
)
query("delete_request", "SELECT * FROM $requests WHERE id <> 100")(lambda t: state.delete(t["requests"], F.col("id") == 100))
query("stored_object_refs", "SELECT DISTINCT content_hash, left(content_hash, 2) || '/' || content_hash AS storage_ref FROM $versions")(lambda t: t["versions"].select("content_hash", F.concat(F.left("content_hash", F.lit(2)), F.lit("/"), "content_hash").alias("storage_ref")).distinct())
query("insert_or_ignore_sent", f"SELECT notification_type, subject_key, scheduled_for FROM $sent UNION SELECT notification_type, subject_key, scheduled_for FROM ({_CANDIDATES}) c")(
    lambda t: state.insert_or_ignore(t["sent"].select("notification_type", "subject_key", "scheduled_for"), _candidates(t).select("notification_type", "subject_key", "scheduled_for"), ["notification_type", "subject_key", "scheduled_for"])
)
query("clear_deferral", "SELECT * FROM $deferrals WHERE resource_id <> 16")(lambda t: state.delete(t["deferrals"], F.col("resource_id") == 16))
query("set_classification", "SELECT * REPLACE (CASE WHEN id = 3 THEN 'past' ELSE timeline_classification END AS timeline_classification) FROM $courses")(lambda t: state.update(t["courses"], F.col("id") == 3, timeline_classification=F.lit("past")))
_SOUND = f"(SELECT * FROM $rule_drafts WHERE set_id NOT IN (SELECT set_id FROM {_VIOLATIONS} v))"
query("replace_rules", f"SELECT set_id, id, offset_seconds, enabled, updated_at FROM $rule_sets WHERE set_id NOT IN (SELECT set_id FROM {_SOUND} s) UNION ALL SELECT set_id, id, offset_seconds, true, 'now' FROM {_SOUND} s")(
    lambda t: state.replace_rule_sets(t["rule_sets"], t["rule_drafts"], "now", "set_id").select("set_id", "id", "offset_seconds", "enabled", "updated_at")
)


def _outcomes(t: Lens) -> DataFrame:
    return t["resources"].selectExpr("id AS resource_id", "CASE WHEN id % 3 = 0 THEN 'done' WHEN id % 3 = 1 THEN 'too_large' ELSE 'failed' END AS outcome", "id AS size_bytes", "1L AS limit_bytes", "id AS source_timemodified", "'now' AS at")


query("record_outcomes_checks", "SELECT id AS resource_id, id AS source_timemodified, 'now' AS checked_at FROM $resources WHERE id % 3 = 0")(lambda t: state.record_outcomes(_outcomes(t))[0])
query("record_outcomes_cleared", "SELECT id AS resource_id FROM $resources WHERE id % 3 = 0")(lambda t: state.record_outcomes(_outcomes(t))[1])
query("record_outcomes_deferred", "SELECT id AS resource_id, 'too_large' AS reason, id AS size_bytes, CAST(1 AS BIGINT) AS limit_bytes, id AS source_timemodified, 'now' AS deferred_at FROM $resources WHERE id % 3 = 1")(lambda t: state.record_outcomes(_outcomes(t))[2])
query("deferrals_after_batch", "SELECT * FROM $deferrals WHERE resource_id % 3 = 2 UNION ALL SELECT id, 'too_large', id, 1, id, 'now' FROM $resources WHERE id % 3 = 1")(lambda t: state.deferrals_after(t["deferrals"], *state.record_outcomes(_outcomes(t))[1:]))
_TRIED = "SELECT v.id AS resource_version_id, 'basic' AS depth, 'plain_text' AS extractor_name, '1' AS extractor_version, CASE WHEN v.id % 2 = 0 THEN 'done' ELSE 'failed' END AS status, CASE WHEN v.id % 2 = 1 THEN 'why ' || v.id END AS error_reason, CASE WHEN v.id % 2 = 0 THEN v.content_hash END AS extracted_text, CAST(NULL AS VARCHAR) AS metadata, 'now' AS extracted_at FROM $versions v WHERE v.version_number = 1"
query("append_extractions", f"SELECT * FROM $extractions UNION ALL BY NAME SELECT (SELECT max(id) FROM $extractions) + row_number() OVER (ORDER BY sha256(CAST(resource_version_id AS VARCHAR))) AS id, * FROM ({_TRIED}) n")(
    lambda t: _appended(t, "extractions", t.sql(_TRIED.replace("VARCHAR", "STRING")), ["resource_version_id"])
)
query("start_execution", "SELECT * FROM $executions UNION ALL BY NAME SELECT max(id) + 1 AS id, 'ingestion' AS job_name, 'manual' AS trigger, 2 AS attempt, 'running' AS status, 'now' AS started_at FROM $executions")(
    lambda t: _begun(t)
)
query("requests_taken", "SELECT r.id, r.job_name, EXISTS (SELECT 1 FROM $executions e WHERE e.job_name = r.job_name AND (e.finished_at IS NULL OR e.finished_at >= r.requested_at)) AS served FROM $requests r")(lambda t: history.waiting_requests(t["requests"], t["executions"]).select("id", "job_name", "served"))
query("purged_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS before, {'0' if n in schema.PURGED else 'count(*)'} AS after FROM ${n}" for n in (*_COUNTED, "executions", "requests", "sent")))(
    lambda t: schema.purge_report({n: t[n] for n in (*_COUNTED, "executions", "requests", "sent")})
)
query("purged_and_kept", " UNION ALL ".join(f"SELECT '{n}' AS table_name, {str(n in schema.KEPT).lower()} AS kept, count(*) AS n FROM ${n}" for n in (*_COUNTED, "executions", "requests", "sent")))(
    lambda t: history.table_counts({n: t[n] for n in (*_COUNTED, "executions", "requests", "sent")}).select("table_name", F.col("table_name").isin(*schema.KEPT).alias("kept"), "n")
)
query("storage_totals", "SELECT count(*) AS objects, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT sha256(text) AS h, max(strlen(text)) AS n FROM $documents GROUP BY 1) x")(lambda t: warehouse.totals(warehouse.addressed(t["documents"].select(F.encode("text", "UTF-8").alias("content")))))

# --- integrity --------------------------------------------------------------------------------------

_FK = [(c, k, p) for c, k, p in schema.REFERENCES if c not in ("users",)]
query(
    "fk_violations",
    " UNION ALL ".join(f"SELECT '{c}' AS child, '{k}' AS reference, CAST({schema.keys(c)[0][0]} AS VARCHAR) AS id FROM ${c} x WHERE x.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ${p} p WHERE p.{schema.keys(p)[0][0]} = x.{k})" for c, k, p in _FK),
)(lambda t: schema.fk_violations({n: t[n] for n in _COUNTED}))
query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM $lineitem GROUP BY ALL HAVING count(*) > 1")(lambda t: schema.duplicate_keys(t["lineitem"], ["l_orderkey", "l_linenumber"]))
query("documents_without_label", "SELECT doc_id FROM $documents d WHERE NOT EXISTS (SELECT 1 FROM $labels l WHERE d.doc_id = l.doc_id)")(lambda t: t["documents"].select("doc_id").join(t["labels"].select("doc_id"), "doc_id", "left_anti"))
query("unknown_keys", "SELECT event_type AS key FROM $events EXCEPT SELECT * FROM (SELECT 'view' UNION ALL SELECT 'click') k")(lambda t: t["events"].select(F.col("event_type").alias("key")).subtract(t.spark.sql("SELECT 'view' AS key UNION ALL SELECT 'click'")))

# --- payloads ---------------------------------------------------------------------------------------

_CONTENTS_JSON = """concat('[{"id":', CAST(id * 10 AS STRING), ',"section":1,"name":"S","visible":', CASE id % 3 WHEN 0 THEN '0' WHEN 1 THEN 'null' ELSE '1' END, ',"modules":[{"id":', CAST(id * 100 AS STRING), ',"modname":"url","url":"u","contents":[]},{"id":', CAST(id * 100 + 1 AS STRING), ',"modname":"resource","visible":1,"contents":[{"type":"file","filename":"a.pdf","fileurl":"f', CAST(id AS STRING), '","timemodified":5},{"type":"url","fileurl":"no"},{"type":"file","fileurl":""}]}]},{"id":', CAST(id * 10 + 1 AS STRING), '}]')"""


def _contents(t: Lens) -> DataFrame:
    return t.sql(f"SELECT id AS course_id, {_CONTENTS_JSON} AS payload FROM $courses")


query("normalize_user", "SELECT CAST(id AS BIGINT) AS id, CASE WHEN id % 2 = 0 THEN '' ELSE username END AS username, '' AS fullname FROM $users")(
    lambda t: normalize.user(t.sql("""SELECT concat('{"userid":', CAST(id AS STRING), CASE WHEN id % 2 = 0 THEN '' ELSE concat(',"username":"', username, '"') END, '}') AS payload FROM $users"""))
)
query("normalize_courses", "SELECT id, shortname, '' AS fullname, CAST(NULL AS BIGINT) AS category, id % 4 NOT IN (1, 2) AS visible, CASE WHEN id % 2 = 0 THEN CAST(12.5 AS DOUBLE) END AS progress, id AS startdate, CAST(NULL AS BIGINT) AS enddate FROM $courses")(
    lambda t: normalize.courses(t.sql("""SELECT concat('[{"id":', CAST(id AS STRING), ',"shortname":"', shortname, '"', CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN ',"visible":null' WHEN 2 THEN ',"visible":0' ELSE ',"visible":1' END, CASE WHEN id % 2 = 0 THEN ',"progress":12.5' ELSE '' END, ',"startdate":', CAST(id AS STRING), '}]') AS payload FROM $courses"""))
)
query("normalize_sections", "SELECT id * 10 AS id, id AS course_id, CAST(1 AS BIGINT) AS section_number, 'S' AS name, '' AS summary, id % 3 = 2 AS visible FROM $courses UNION ALL SELECT id * 10 + 1, id, NULL, '', '', true FROM $courses")(lambda t: normalize.sections(_contents(t)))
query("normalize_contents", "SELECT id * 100 AS id, id AS course_id, id * 10 AS section_id, 'url' AS modname, '' AS name, 'u' AS url, true AS visible FROM $courses UNION ALL SELECT id * 100 + 1, id, id * 10, 'resource', '', NULL, true FROM $courses")(lambda t: normalize.modules(_contents(t)))
query("normalize_files", "SELECT id * 100 + 1 AS module_id, 'a.pdf' AS filename, '/' AS filepath, CAST(0 AS BIGINT) AS filesize, CAST(NULL AS VARCHAR) AS mimetype, 'f' || CAST(id AS VARCHAR) AS fileurl, CAST(5 AS BIGINT) AS timemodified FROM $courses")(lambda t: normalize.files(_contents(t)))
query("normalize_assignments", "SELECT id, course_id, name, duedate, allowsubmissionsfromdate, cutoffdate, grade FROM $assignments")(
    lambda t: normalize.assignments(t["assignments"].groupBy("course_id").agg(F.collect_list(F.struct("id", "name", "duedate", "allowsubmissionsfromdate", "cutoffdate", "grade")).alias("assignments")).select(F.to_json(F.struct(F.array(F.struct(F.col("course_id").alias("id"), "assignments")).alias("courses"))).alias("payload")))
)
query("normalize_grades", "SELECT id, course_id, user_id, cmid, item_name, item_type, item_module, grade_raw, grade_formatted, percentage_formatted FROM $grades")(
    lambda t: normalize.grades(
        dealt(t["grades"], t.rows("lineitem"), "course_id").groupBy("course_id", "user_id").agg(F.collect_list(F.struct("id", "cmid", F.col("item_name").alias("itemname"), F.col("item_type").alias("itemtype"), F.col("item_module").alias("itemmodule"), F.col("grade_raw").alias("graderaw"), F.col("grade_formatted").alias("gradeformatted"), F.col("percentage_formatted").alias("percentageformatted"))).alias("gradeitems"))
        .select(F.to_json(F.struct(F.array(F.struct(F.col("course_id").alias("courseid"), F.col("user_id").alias("userid"), "gradeitems")).alias("usergrades"))).alias("payload"))
    )
)
query("normalize_calendar", "SELECT id, course_id, name, eventtype AS description, eventtype, modulename, instance, timestart, timesort, timeduration FROM $calendar")(
    lambda t: normalize.calendar(t["calendar"].select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct("id", "name", "description", "eventtype", "modulename", "instance", "timestart", "timesort", "timeduration", F.when(F.col("course_id").isNotNull(), F.struct(F.col("course_id").alias("id"))).alias("course"))).alias("events"))).alias("groupedbycourse"))).alias("payload")))
)
query("submission_fallback", "SELECT id AS assignment_id, CASE id % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'team' WHEN 2 THEN NULL ELSE NULL END AS submission_status, CASE WHEN id % 4 <> 3 THEN 'g' END AS grading_status, CASE WHEN id % 4 = 0 THEN true END AS cansubmit, CASE id % 4 WHEN 1 THEN CAST(9 AS BIGINT) END AS submitted_at FROM $courses")(
    lambda t: normalize.submission_status(t.sql("""SELECT id AS assignment_id, CASE id % 4 WHEN 0 THEN '{"lastattempt":{"gradingstatus":"g","cansubmit":true,"submission":{"status":"own"},"teamsubmission":{"status":"team","timemodified":9}}}' WHEN 1 THEN '{"lastattempt":{"gradingstatus":"g","submission":{},"teamsubmission":{"status":"team","timemodified":9}}}' WHEN 2 THEN '{"lastattempt":{"gradingstatus":"g"}}' ELSE '{}' END AS payload FROM $courses"""))
)
query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM $events")(lambda t: t["events"].select("event_id", normalize.metadata("props")["k"].cast("bigint").alias("k")))
query("api_error_detection", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'auth' WHEN 1 THEN 'api' END AS kind FROM $events")(
    lambda t: t.sql("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"exception":"e","errorcode":"invalidtoken"}' WHEN 1 THEN '{"exception":"e","errorcode":"x","message":"m"}' WHEN 2 THEN '{"errorcode":"invalidtoken"}' ELSE '[]' END AS j FROM $events""").select("event_id", text.api_error("j").alias("kind"))
)

# --- text rules -------------------------------------------------------------------------------------

query("strip_html", "SELECT page_id, nullif(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS plain FROM $pages")(lambda t: t["pages"].select("page_id", text.strip_markup("html").alias("plain")))
_SECRETS = "concat('GET /x?WsToken=abc', CAST(doc_id AS STRING), '&b=1 bot123456', CAST(doc_id AS STRING), ':AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA-_ and hunter2hunter2 ', text)"
query("redact_secrets", f"SELECT doc_id, replace(regexp_replace(regexp_replace({_SECRETS}, '(?i)((?:ws)?token=)[^&\\s''\"<>]+', '\\1***', 'g'), '[0-9]{{6,}}:[A-Za-z0-9_-]{{30,}}', '***', 'g'), 'hunter2hunter2', '***') AS safe FROM $documents")(
    lambda t: t.sql(f"SELECT doc_id, {_SECRETS} AS s FROM $documents").select("doc_id", text.redact("s", ["hunter2hunter2", "short"]).alias("safe"))
)
_SAFE = """'E: ' || regexp_replace(regexp_replace(x.s, '(?i)((?:ws)?token=)[^&\\s''\"<>]+', '\\1***', 'g'), '[0-9]{6,}:[A-Za-z0-9_-]{30,}', '***', 'g')"""
query("safe_error", f"SELECT doc_id, CASE WHEN length({_SAFE}) > 1000 THEN left({_SAFE}, 997) || '...' ELSE {_SAFE} END AS error FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'call of /x?wsTOKEN=a' || doc_id || '&b failed: ' ELSE '' END || text AS s FROM $documents) x")(
    lambda t: t.sql("SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN concat('call of /x?wsTOKEN=a', CAST(doc_id AS STRING), '&b failed: ') ELSE '' END, text) AS s FROM $documents").select("doc_id", text.safe_error(F.lit("E"), "s").alias("error"))
)
query("url_token_redaction", "SELECT id, 'https://example.edu/f/' || CAST(id AS VARCHAR) || '?token=%2A%2A%2A&forcedownload=1' AS safe FROM $files")(lambda t: t["files"].select("id", text.redact_url("fileurl").alias("safe")))
query("url_token_replacement", "SELECT id, 'https://example.edu/f/' || CAST(id AS VARCHAR) || '?forcedownload=1&token=own' AS url FROM $files")(lambda t: t["files"].select("id", text.authenticated_url("fileurl", "own").alias("url")))
query("trusted_url", "SELECT id, fileurl LIKE 'https://example.edu/%' AS ok, false AS other, false AS down FROM $files")(
    lambda t: t["files"].select("id", text.trusted("fileurl", "example.edu").alias("ok"), text.trusted(F.replace("fileurl", F.lit("example.edu"), F.lit("evil-example.edu")), "example.edu").alias("other"), text.trusted(F.replace("fileurl", F.lit("https"), F.lit("http")), "example.edu").alias("down"))
)
query("error_description", "SELECT doc_id, ': ' || left(source || text, 200) AS why, '' AS none FROM $documents WHERE source <> ''")(lambda t: t["documents"].filter("source <> ''").select("doc_id", text.error_description(F.to_json(F.struct(F.concat("source", "text").alias("description")))).alias("why"), text.error_description(F.lit("{}")).alias("none")))
query("file_extension", "SELECT id, '.pdf' AS e, CASE WHEN id % 2 = 0 THEN '' ELSE '.gz' END AS f FROM $files")(lambda t: t["files"].select("id", text.extension("filename").alias("e"), text.extension(F.when(F.col("id") % 2 == 0, ".bashrc").otherwise("A.TAR.GZ")).alias("f")))

# --- extraction -------------------------------------------------------------------------------------

query("extractor_dispatch", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'plain_text' WHEN 1 THEN 'pdf_hybrid' WHEN 2 THEN 'pptx' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'html_text' ELSE 'xls' END AS extractor_name FROM $part")(
    lambda t: t.sql("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'text/plain' WHEN 4 THEN 'text/html' WHEN 5 THEN 'application/vnd.ms-excel' END AS m, CASE p_partkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.pdf' WHEN 2 THEN '.ppsx' WHEN 3 THEN '.png' ELSE '' END AS e FROM $part").select("p_partkey", extraction.extractor("m", "e").alias("extractor_name"))
)
query("plain_text_extract", "SELECT doc_id, 'done' AS status, text AS extracted_text, length(text) AS char_count FROM $documents")(
    lambda t: t["documents"].select("doc_id", extraction.decoded(F.encode("text", "UTF-8")).alias("extracted_text")).select("doc_id", F.when(F.col("extracted_text").isNotNull(), "done").otherwise("failed").alias("status"), "extracted_text", F.length("extracted_text").cast("bigint").alias("char_count"))
)
query("html_visible_text")(lambda t: extraction.extract(t["pages"].select("page_id", F.encode("html", "UTF-8").alias("content"), F.lit("html_text").alias("extractor_name"))))
query("extract_unsupported", "SELECT page_id, 'unsupported' AS extractor_name, 'failed' AS status, CAST(NULL AS VARCHAR) AS extracted_text FROM $pages")(
    lambda t: extraction.extract(t["pages"].select("page_id", F.encode("html", "UTF-8").alias("content"), F.lit("unsupported").alias("extractor_name"))).select("page_id", "extractor_name", "status", "extracted_text")
)
query("native_text_sufficient", "SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] >= 1500 AS enough FROM $documents GROUP BY source")(lambda t: t["documents"].groupBy("source").agg(F.collect_list("n_chars").alias("p")).select("source", rules.sufficient("p", 1500).alias("enough")))
query("render_scale", "SELECT p_partkey, round(CASE WHEN (p_size * 200.0) * (200 / 72.0) * (p_size * 150.0) * (200 / 72.0) > 50000000 THEN (200 / 72.0) * sqrt(50000000 / ((p_size * 200.0) * (200 / 72.0) * (p_size * 150.0) * (200 / 72.0))) ELSE 200 / 72.0 END, 6) AS scale, CAST(p_size * 1000 AS BIGINT) * (p_size * 100) <= 50000000 AS ok FROM $part")(
    lambda t: t["part"].select("p_partkey", F.round(rules.render_scale(F.col("p_size") * F.lit(200.0), F.col("p_size") * F.lit(150.0)), 6).alias("scale"), rules.image_allowed(F.col("p_size") * 1000, F.col("p_size") * 100).alias("ok"))
)
query(
    "zip_member_safety",
    f"""WITH RECURSIVE r AS (SELECT p_partkey, p_size, 0 AS i, CAST(0 AS BIGINT) AS total, '' AS ok FROM $part UNION ALL
    SELECT p_partkey, p_size, i + 1, total + CASE WHEN fits THEN s ELSE 0 END, ok || CASE WHEN fits THEN 'y' ELSE 'n' END
    FROM (SELECT *, s <= {rules.MEMBER_BYTES} AND s <= {rules.MEMBER_RATIO} * (i + 1) * 100000 AND total + s <= {rules.TOTAL_BYTES} AS fits FROM (SELECT *, CAST(i + 1 AS BIGINT) * p_size * 1000000 AS s FROM r WHERE i < 9) a) b)
    SELECT p_partkey, ok FROM r WHERE i = 9""",
)(lambda t: t["part"].select("p_partkey", F.array_join(F.transform(rules.safe_members(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct((i.cast("bigint") * F.col("p_size") * 1000000).alias("size"), (i * 100000).alias("packed")))), lambda x: F.when(x, "y").otherwise("n")), "").alias("ok")))
def _read_back(t: Lens) -> DataFrame:
    """Every twentieth document's original, read by its hash from a store of all."""
    content, root = F.encode("text", "UTF-8").alias("content"), new_path(t.spark, "originals")
    warehouse.store(t["documents"].select(content), root, reserve=0)
    hashes = t["documents"].filter("doc_id % 20 = 0").select(F.sha2(content, 256).alias("content_hash"))
    return warehouse.retrieve(t.spark, root, hashes).select("content_hash", F.length("content").cast("bigint").alias("size_bytes"), F.md5("content").alias("md5"))


query("originals_by_hash", "SELECT DISTINCT sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size_bytes, md5(text) AS md5 FROM $documents WHERE doc_id % 20 = 0")(_read_back)
query("content_dedup", "SELECT sha256(text) AS content_hash, left(sha256(text), 2) || '/' || sha256(text) AS storage_ref, CAST(max(strlen(text)) AS BIGINT) AS size_bytes FROM $documents GROUP BY 1, 2")(lambda t: warehouse.addressed(t["documents"].select(F.encode("text", "UTF-8").alias("content"))).drop("content"))
query("url_reference_bytes", "SELECT id, sha256(url) AS content_hash, 'text/uri-list' AS mimetype FROM $modules WHERE url <> ''")(lambda t: t["modules"].filter("url <> ''").select("id", F.sha2(queues.url_bytes("url"), 256).alias("content_hash"), queues.default_mimetype(F.lit("url"), F.lit(None).cast("string")).alias("mimetype")))
query("depth_validity", "SELECT id, depth IN ('basic', 'deep') AS valid FROM $extractions")(lambda t: t["extractions"].select("id", rules.valid_depth("depth").alias("valid")))


_NESTED = """CASE event_id % 3 WHEN 0 THEN concat('{"options":[', props, ',{"on":true,"off":false,"none":null}],"empty":{},"list":[]}')
    WHEN 1 THEN concat('{"a":{"b":[1,[2.5,{"c":', CAST(event_id AS STRING), '}]]}}') ELSE concat('[{"user":{"id":', CAST(user_id AS STRING), ',"tags":["x","', event_type, '"]}}]') END"""
_FIELDS = [(0, "options[0][k]", "json_extract_string(props, '$.k')"), (0, "options[1][on]", "'1'"), (0, "options[1][off]", "'0'"), (0, "options[1][none]", "''"), (1, "a[b][0]", "'1'"), (1, "a[b][1][0]", "'2.5'"), (1, "a[b][1][1][c]", "CAST(event_id AS VARCHAR)"), (2, "0[user][id]", "CAST(user_id AS VARCHAR)"), (2, "0[user][tags][0]", "'x'"), (2, "0[user][tags][1]", "event_type")]
query("flatten_params", " UNION ALL ".join(f"SELECT event_id, '{field}' AS field, {value} AS value FROM $events WHERE event_id % 3 = {shape}" for shape, field, value in _FIELDS))(
    lambda t: platform.form_fields(t.sql(f"SELECT event_id, {_NESTED} AS params FROM $events"), "params", "event_id")
)

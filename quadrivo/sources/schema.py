"""The 19 tables: columns, keys, references; checks that Spark does not make by itself."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import parts
from .scratch import written

_SYNCED = ", created_at string, last_synced_at string"
COLUMNS = {
    "users": "id long, username string, fullname string" + _SYNCED,
    "courses": "id long, shortname string, fullname string, category long, visible boolean, progress double, startdate long, enddate long, timeline_classification string" + _SYNCED,
    "sections": "id long, course_id long, section_number long, name string, summary string, visible boolean" + _SYNCED,
    "modules": "id long, course_id long, section_id long, modname string, name string, url string, visible boolean" + _SYNCED,
    "files": "id long, module_id long, filename string, filepath string, filesize long, mimetype string, fileurl string, timemodified long" + _SYNCED,
    "assignments": "id long, course_id long, name string, duedate long, allowsubmissionsfromdate long, cutoffdate long, grade double" + _SYNCED,
    "submissions": "assignment_id long, submission_status string, grading_status string, cansubmit boolean, submitted_at long" + _SYNCED,
    "grades": "id long, course_id long, user_id long, cmid long, item_name string, item_type string, item_module string, grade_raw double, grade_formatted string, percentage_formatted string" + _SYNCED,
    "calendar": "id long, course_id long, name string, description string, eventtype string, modulename string, instance long, timestart long, timesort long, timeduration long" + _SYNCED,
    "resources": "id long, origin string, source_type string, external_reference string, course_id long, section_id long, module_id long, name string, source_url string" + _SYNCED,
    "versions": "id long, resource_id long, version_number long, content_hash string, storage_ref string, size_bytes long, mimetype string, ingested_at string",
    "extractions": "id long, resource_version_id long, depth string, extractor_name string, extractor_version string, status string, error_reason string, extracted_text string, metadata string, extracted_at string",
    "checks": "resource_id long, source_timemodified long, checked_at string",
    "deferrals": "resource_id long, reason string, size_bytes long, limit_bytes long, source_timemodified long, deferred_at string",
    "executions": "id long, job_name string, trigger string, attempt long, status string, started_at string, finished_at string, duration_seconds double, items_processed long, detail string, error string",
    "requests": "id long, job_name string, requested_at string",
    "sent": "id long, notification_type string, subject_key string, scheduled_for string, sent_at string",
    "rules": "id string, offset_seconds long, enabled boolean, title_template string, body_template string, updated_at string",
    "rules_saved": "id long, saved_at string",
}
KEYS = {"files": [["id"], ["fileurl"]], "submissions": [["assignment_id"]], "checks": [["resource_id"]], "deferrals": [["resource_id"]], "resources": [["id"], ["origin", "source_type", "external_reference"]], "versions": [["id"], ["resource_id", "version_number"]], "sent": [["id"], ["notification_type", "subject_key", "scheduled_for"]]}
#: child table, its column, parent table
REFERENCES = [
    ("sections", "course_id", "courses"), ("modules", "course_id", "courses"), ("modules", "section_id", "sections"), ("files", "module_id", "modules"),
    ("assignments", "course_id", "courses"), ("submissions", "assignment_id", "assignments"), ("grades", "course_id", "courses"), ("grades", "user_id", "users"),
    ("calendar", "course_id", "courses"), ("versions", "resource_id", "resources"), ("extractions", "resource_version_id", "versions"), ("checks", "resource_id", "resources"), ("deferrals", "resource_id", "resources"),
]
#: What a purge empties, children first, and what it keeps.
PURGED = ("extractions", "deferrals", "checks", "versions", "resources", "submissions", "grades", "calendar", "assignments", "files", "modules", "sections", "courses", "users")
KEPT = ("executions", "requests", "sent", "rules", "rules_saved")


def keys(table: str) -> list[list[str]]:
    return KEYS.get(table, [["id"]])


def identity(table: str) -> list[str]:
    """The columns by which a row takes the place of another: those that a batch knows a row by."""
    return {"files": ["fileurl"], "resources": ["origin", "source_type", "external_reference"]}.get(table, keys(table)[0])


def looked_up_by(table: str) -> list[str]:
    """The columns by which a table's rows are looked up, and its buckets dealt."""
    return {"versions": ["resource_id"], "extractions": ["resource_version_id"], "sent": ["notification_type", "subject_key", "scheduled_for"]}.get(table, identity(table))


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(COLUMNS[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def references(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, key, child, reference, id: each row's own key (child null), if its table is a parent, and each of its references (not null) to another table's key, from one pass over each table."""
    within = [(c, k, p) for c, k, p in REFERENCES if c in tables and p in tables]
    if not within:
        raise ValueError("no table with a reference among these")
    out = None
    for name in dict.fromkeys([c for c, _, _ in within] + [p for _, _, p in within]):
        own, text = F.col(keys(name)[0][0]), F.lit(None).cast("string")
        entry = lambda table, key, child, column, i: F.struct(F.lit(table).alias("table_name"), key.cast("bigint").alias("key"), child.alias("child"), column.alias("reference"), i.alias("id"))
        entries = [entry(name, own, text, text, text)] if any(p == name for _, _, p in within) else []
        entries += [entry(p, F.col(k), F.lit(name), F.lit(k), own.cast("string")) for c, k, p in within if c == name]
        rows = tables[name].select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter("key IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def fk_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """child, reference, id of rows whose parent is missing; a null reference is none. Each table is read once, its keys and references written down together, and one join meets them all.

    A key that very many rows refer to would be one task's, however its rows are dealt. Such keys are looked up by themselves, and their rows kept or left where they lie.
    """
    entries = written(references(tables), "references")
    rows, meet = entries.count(), ["table_name", "key"]
    held, named = entries.filter("child IS NULL").select(*meet), entries.filter("child IS NOT NULL")
    if rows <= parts.ROWS:
        return named.join(held, meet, "left_anti").select("child", "reference", "id")
    often = written(crowded(named, parts.ROWS), "crowded")
    lost = often.join(held.join(F.broadcast(often), meet, "left_semi").distinct(), meet, "left_anti")
    few = parts.dealt(named.join(F.broadcast(often), meet, "left_anti"), rows, *meet).join(parts.dealt(held, rows, *meet), meet, "left_anti")
    return few.unionByName(named.join(F.broadcast(lost), meet, "left_semi").select(*few.columns)).select("child", "reference", "id")


def crowded(named: DataFrame, rows: int) -> DataFrame:
    """table_name, key that more than about so many rows refer to, told by one row in 256 of each; at most one key for every rows / 2 rows. Which keys these are bears on the work only, every row is met whatever they are."""
    some = named.filter(F.pmod(F.xxhash64("child", "reference", "id"), F.lit(256)) == 0)
    return some.groupBy("table_name", "key").agg(F.count("*").alias("m")).filter(F.col("m") > rows // 512).select("table_name", "key")


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once, with n."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def after_purge(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as a purge leaves them: academic ones empty, the others as they are."""
    return {name: df.limit(0) if name in PURGED else df for name, df in tables.items()}


def purge_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, before and after: rows of each table around a purge."""
    left, out = after_purge(tables), None
    for name, df in tables.items():
        rows = df.select(F.lit(0).alias("after")).unionByName(left[name].select(F.lit(1).alias("after")))
        counted = rows.agg(F.count_if(F.col("after") == 0).alias("before"), F.count_if(F.col("after") == 1).alias("after")).select(F.lit(name).alias("table_name"), "before", "after")
        out = counted if out is None else out.unionByName(counted)
    return out

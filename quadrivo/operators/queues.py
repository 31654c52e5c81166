"""Work queues: what is still to be ingested, extracted or refreshed, and what has been given up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_versions

UNSUPPORTED, MAX_FAILURES = "unsupported", 3
INGESTION_BUDGET, EXTRACTION_BUDGET = 100, 50
NEW, CHANGED, RETRY = 0, 1, 2
ORIGIN = "moodle"  # fixed value: the origin of everything that the platform's interface reports
URL_TYPE = "text/uri-list"


def _attempts(extractions: DataFrame, depth: str) -> tuple[DataFrame, DataFrame]:
    """Of a depth: versions that are settled (extracted or unsupported), and the failures of each version."""
    rows = extractions.filter(F.col("depth") == depth)
    settled = rows.filter((F.col("status") == "done") | (F.col("extractor_name") == UNSUPPORTED)).select(F.col("resource_version_id").alias("_v"))
    failed = rows.filter(F.col("status") == "failed").groupBy(F.col("resource_version_id").alias("_v"))
    return settled, failed


def pending_extraction(versions: DataFrame, extractions: DataFrame, depth: str = "basic", most: int = MAX_FAILURES) -> DataFrame:
    """id, failed_count of latest versions that are neither settled nor given up; to be taken by failed_count, then id."""
    settled, failed = _attempts(extractions, depth)
    latest = latest_versions(versions.select("id", "resource_id", "version_number"))
    open_ = latest.join(settled, latest.id == F.col("_v"), "left_anti")
    counts = failed.agg(F.count("*").alias("_n"))
    joined = open_.join(counts, open_.id == F.col("_v"), "left").select("id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("failed_count"))
    return joined.filter(F.col("failed_count") < most)


def abandoned_versions(versions: DataFrame, resources: DataFrame, extractions: DataFrame, depth: str = "basic", most: int = MAX_FAILURES) -> DataFrame:
    """The complement of pending_extraction: unsettled latest versions with `most` failures or more, and the last of these."""
    settled, failed = _attempts(extractions, depth)
    latest = latest_versions(versions.select("id", "resource_id", "version_number", "size_bytes", "mimetype"))
    given_up = failed.agg(F.count("*").alias("failures"), F.max("extracted_at").alias("last_attempt_at"), F.max_by("error_reason", "id").alias("last_error")).filter(F.col("failures") >= most)
    open_ = latest.join(settled, latest.id == F.col("_v"), "left_anti").join(given_up, latest.id == F.col("_v"))
    names = resources.select(F.col("id").alias("_r"), "name", "course_id")
    return open_.join(names, F.col("resource_id") == F.col("_r")).select(F.col("id").alias("version_id"), "size_bytes", "mimetype", "name", "course_id", "failures", "last_attempt_at", "last_error")


def current_rows(rows: DataFrame, sections: DataFrame, stamp: str = "last_synced_at", course: str = "course_id") -> DataFrame:
    """Rows seen by the newest sync of their course's sections. Without sections, or without a stamp, that is unknown, and the row is left out."""
    newest = sections.groupBy(F.col("course_id").alias("_c")).agg(F.max("last_synced_at").alias("_newest"))
    return rows.join(newest, F.col(course) == F.col("_c")).filter(~(F.col(stamp) < F.col("_newest"))).drop("_c", "_newest")


def file_descriptors(files: DataFrame, modules: DataFrame, sections: DataFrame) -> DataFrame:
    m = modules.select(F.col("id").alias("_m"), "course_id", "section_id")
    rows = current_rows(files.join(m, F.col("module_id") == F.col("_m")), sections)
    return rows.select(F.lit(ORIGIN).alias("origin"), F.lit("file").alias("source_type"), F.col("fileurl").alias("external_reference"), "course_id", "section_id", "module_id", F.col("filename").alias("name"), F.col("fileurl").alias("source_url"), "mimetype", F.col("timemodified").alias("source_timemodified"))


def url_descriptors(modules: DataFrame, sections: DataFrame) -> DataFrame:
    rows = current_rows(modules.filter((F.col("modname") == "url") & (F.col("url") != "")), sections)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("url"))
    return rows.select(F.lit(ORIGIN).alias("origin"), F.lit("url").alias("source_type"), F.col("id").cast("string").alias("external_reference"), "course_id", "section_id", F.col("id").alias("module_id"), name.alias("name"), F.col("url").alias("source_url"), F.lit(None).cast("string").alias("mimetype"), F.lit(None).cast("bigint").alias("source_timemodified"))


def descriptors(files: DataFrame, modules: DataFrame, sections: DataFrame) -> DataFrame:
    return file_descriptors(files, modules, sections).unionByName(url_descriptors(modules, sections))


def default_mimetype(source_type: Column | str, mimetype: Column | str) -> Column:
    s, m = (F.col(c) if isinstance(c, str) else c for c in (source_type, mimetype))
    return F.coalesce(m, F.when(s == "url", F.lit(URL_TYPE)))


def url_bytes(url: Column | str) -> Column:
    """What is stored for an address: its text in UTF-8."""
    return F.encode(F.col(url) if isinstance(url, str) else url, "UTF-8")


def ingestion_pending(found: DataFrame, resources: DataFrame, versions: DataFrame, checks: DataFrame, deferrals: DataFrame) -> DataFrame:
    """Descriptors that need work, with work_group (NEW, CHANGED, RETRY), second_key, latest_version_id; to be taken in the order of work_group, second_key, external_reference."""
    r = resources.select(F.col("origin").alias("_o"), F.col("source_type").alias("_s"), F.col("external_reference").alias("_x"), F.col("id").alias("_r"), F.col("last_synced_at").alias("_seen"))
    v = latest_versions(versions.select("id", "resource_id", "version_number", "content_hash")).select(F.col("resource_id").alias("_vr"), F.col("id").alias("latest_version_id"), F.col("content_hash").alias("_hash"))
    c = checks.select(F.col("resource_id").alias("_cr"), F.col("source_timemodified").alias("_checked"))
    d = deferrals.select(F.col("resource_id").alias("_dr"), F.col("source_timemodified").alias("_deferred"))
    rows = (
        found.join(r, (F.col("origin") == F.col("_o")) & (F.col("source_type") == F.col("_s")) & (F.col("external_reference") == F.col("_x")), "left")
        .join(v, F.col("_r") == F.col("_vr"), "left")
        .join(c, F.col("_r") == F.col("_cr"), "left")
        .join(d, F.col("_r") == F.col("_dr"), "left")
    )
    stamp = F.col("source_timemodified")
    url_changed = F.sha2(F.encode("source_url", "UTF-8"), 256) != F.col("_hash")
    file_changed = F.col("_cr").isNull() | ~F.col("_checked").eqNullSafe(stamp)
    group = (
        F.when(F.col("_r").isNull(), NEW)
        .when(F.col("_vr").isNull(), F.when(F.col("_dr").isNull() | ~F.col("_deferred").eqNullSafe(stamp), RETRY))
        .when(F.when(F.col("source_type") == "url", url_changed).otherwise(file_changed), CHANGED)
    )
    return rows.withColumn("work_group", group).filter("work_group IS NOT NULL").select(*found.columns, "work_group", F.coalesce("_seen", F.lit("")).alias("second_key"), "latest_version_id")


def budget(work: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first `most` items of work; the rest waits for the next run."""
    return work.orderBy(*order).limit(most)


def listed_deferrals(deferrals: DataFrame, resources: DataFrame) -> DataFrame:
    """Resources that were looked at and not ingested; to be shown by size, largest first, then id."""
    r = resources.select(F.col("id").alias("_r"), "name", "course_id")
    return deferrals.join(r, F.col("resource_id") == F.col("_r")).select("resource_id", "reason", "size_bytes", "limit_bytes", "deferred_at", "name", "course_id")


def needs_status(assignments: DataFrame, statuses: DataFrame, now: int) -> DataFrame:
    """Assignments whose submission was never read, or may still change."""
    s = statuses.select(F.col("assignment_id").alias("_a"), "submission_status")
    open_ = (F.col("duedate") > now) & (F.col("submission_status").isNull() | (F.col("submission_status") != "submitted"))
    return assignments.join(s, assignments.id == F.col("_a"), "left").filter(F.col("_a").isNull() | open_).select("id")


def changed_courses(returned: DataFrame, sections: DataFrame, updates: DataFrame, full: bool) -> DataFrame:
    """Courses to read again: all in a full run; else those never stored and those with updates or warnings (course_id, n_instances, n_warnings)."""
    if full:
        return returned.select("id")
    stored = sections.select(F.col("course_id").alias("_c")).distinct()
    told = updates.groupBy(F.col("course_id").alias("_u")).agg(F.sum(F.col("n_instances") + F.col("n_warnings")).alias("_n"))
    rows = returned.join(stored, returned.id == F.col("_c"), "left").join(told, returned.id == F.col("_u"), "left")
    return rows.filter(F.col("_c").isNull() | (F.col("_n") > 0)).select("id")


def status_refresh(returned: DataFrame, changed: DataFrame, needing: DataFrame) -> DataFrame:
    """Ids of returned assignments that are in changed courses or need their status."""
    c = changed.select(F.col("id").alias("_c"))
    inside = returned.join(c, F.col("course_id") == F.col("_c"), "left_semi").select("id")
    return inside.union(needing.select("id").intersect(returned.select("id"))).distinct()


def labelled_timeline(in_progress: DataFrame, past: DataFrame, future: DataFrame) -> DataFrame:
    """id, timeline_classification from the three lists; of a course in several, the last list's."""
    parts = [df.select("id", F.lit(i).alias("_i"), F.lit(name).alias("timeline_classification")) for i, (df, name) in enumerate(((in_progress, "inprogress"), (past, "past"), (future, "future")))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("id").agg(F.max_by("timeline_classification", "_i").alias("timeline_classification"))

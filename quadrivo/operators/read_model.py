"""Questions about courses, assignments, grades, calendar and materials. Every function returns a lazy DataFrame over the tables given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .latest import latest_extractions, latest_versions

COURSE = ("id", "shortname", "fullname", "category", "is_current", "timeline_classification", "progress", "startdate", "enddate", "last_synced_at")
ASSIGNMENT = ("id", "course_id", "name", "duedate", "allowsubmissionsfromdate", "cutoffdate", "grade", "submission_status", "grading_status", "is_pending", "last_synced_at")
MATERIAL = ("resource_id", "name", "course_id", "section_id", "module_id", "source_type", "source_url", "latest_version_id", "latest_version_number", "mimetype", "size_bytes", "ingested_at", "extraction_status", "extractor_name", "extracted_at")


def courses(table: DataFrame) -> DataFrame:
    return table.withColumn("is_current", rules.flag(rules.current("timeline_classification"))).select(*COURSE)


def current_courses(table: DataFrame) -> DataFrame:
    return courses(table.filter(rules.current("timeline_classification")))


def by_id(table: DataFrame, key: int, column: str = "id") -> DataFrame:
    return table.filter(F.col(column) == key)


def of_course(table: DataFrame, course: int | None) -> DataFrame:
    """Rows of a course, or all for None; a row without a course belongs to none."""
    return table if course is None else table.filter(F.col("course_id") == course)


def with_status(assignments: DataFrame, statuses: DataFrame) -> DataFrame:
    """Assignments with what is known of their submission; one without a status row has nulls."""
    known = statuses.select(F.col("assignment_id").alias("_id"), "submission_status", "grading_status")
    return assignments.join(known, assignments.id == F.col("_id"), "left").drop("_id")


def assignments(table: DataFrame, statuses: DataFrame, now: int, course: int | None = None) -> DataFrame:
    rows = with_status(of_course(table, course), statuses)
    return rows.withColumn("is_pending", rules.flag(rules.pending("duedate", "submission_status", now))).select(*ASSIGNMENT)


def pending_assignments(table: DataFrame, statuses: DataFrame, now: int, course: int | None = None) -> DataFrame:
    """The filter is on the bare condition, so the join becomes inner and both scans are filtered."""
    rows = with_status(of_course(table, course), statuses).filter(rules.pending("duedate", "submission_status", now))
    return rows.withColumn("is_pending", F.lit(True)).select(*ASSIGNMENT)


def upcoming_assignments(table: DataFrame, statuses: DataFrame, now: int, days: int = 7) -> DataFrame:
    rows = with_status(table.filter(rules.upcoming("duedate", now, days)), statuses)
    return rows.withColumn("is_pending", rules.flag(rules.pending("duedate", "submission_status", now))).select(*ASSIGNMENT)


def calendar(events: DataFrame, start: int, end: int, course: int | None = None) -> DataFrame:
    """Events that begin in a range, both ends included."""
    return of_course(events, course).filter(F.col("timestart").between(start, end))


def materials(resources: DataFrame, versions: DataFrame, extractions: DataFrame, course: int | None = None, resource: int | None = None) -> DataFrame:
    """Resources with their latest version and its latest attempt at any depth. Extracted text is never read.

    A restriction to a course or resource is applied before "latest" is worked out, as a semi join on the versions and then on the attempts.
    """
    r = of_course(resources, course) if resource is None else by_id(resources, resource)
    if course is not None or resource is not None:
        versions = versions.join(r.select(F.col("id").alias("_r")), F.col("resource_id") == F.col("_r"), "left_semi")
        extractions = extractions.join(versions.select(F.col("id").alias("_v")), F.col("resource_version_id") == F.col("_v"), "left_semi")
    v = latest_versions(versions.select("id", "resource_id", "version_number", "mimetype", "size_bytes", "ingested_at"))
    e = latest_extractions(extractions.select("id", "resource_version_id", "depth", "status", "extractor_name", "extracted_at"))
    v = v.select(F.col("resource_id").alias("_r"), F.col("id").alias("latest_version_id"), F.col("version_number").alias("latest_version_number"), "mimetype", "size_bytes", "ingested_at")
    e = e.select(F.col("resource_version_id").alias("_v"), F.col("status").alias("extraction_status"), "extractor_name", "extracted_at")
    joined = r.withColumnRenamed("id", "resource_id").join(v, F.col("resource_id") == F.col("_r"), "left").join(e, F.col("latest_version_id") == F.col("_v"), "left")
    return joined.select(*MATERIAL)


def has_contents(courses: DataFrame, sections: DataFrame) -> DataFrame:
    """Courses of which a section is stored."""
    return courses.join(sections.select(F.col("course_id").alias("_c")), F.col("id") == F.col("_c"), "left_semi")


class ReadModel:
    """The questions, asked of tables by name (a mapping or a function from name to DataFrame) and read-only."""

    def __init__(self, tables, now: int):
        self._t, self.now = tables.__getitem__ if hasattr(tables, "__getitem__") else tables, now

    def get_courses(self) -> DataFrame:
        return courses(self._t("courses")).orderBy("fullname")

    def get_current_courses(self) -> DataFrame:
        return current_courses(self._t("courses")).orderBy("fullname")

    def get_course(self, course: int) -> DataFrame:
        return by_id(courses(self._t("courses")), course)

    def get_assignments(self, course: int | None = None) -> DataFrame:
        return assignments(self._t("assignments"), self._t("submissions"), self.now, course).orderBy(F.asc_nulls_first("duedate"))

    def get_assignment(self, assignment: int) -> DataFrame:
        return by_id(assignments(self._t("assignments"), self._t("submissions"), self.now), assignment)

    def get_pending_assignments(self, course: int | None = None) -> DataFrame:
        return pending_assignments(self._t("assignments"), self._t("submissions"), self.now, course).orderBy("duedate")

    def get_upcoming_assignments(self, days: int = 7) -> DataFrame:
        return upcoming_assignments(self._t("assignments"), self._t("submissions"), self.now, days).orderBy("duedate")

    def get_grades(self, course: int | None = None) -> DataFrame:
        return of_course(self._t("grades"), course).orderBy("course_id", F.asc_nulls_first("item_name"))

    def get_calendar_events(self, start: int, end: int, course: int | None = None) -> DataFrame:
        return calendar(self._t("calendar"), start, end, course).orderBy("timestart")

    def get_course_materials(self, course: int) -> DataFrame:
        return materials(self._t("resources"), self._t("versions"), self._t("extractions"), course).orderBy("name")

    def get_material(self, resource: int) -> DataFrame:
        return materials(self._t("resources"), self._t("versions"), self._t("extractions"), resource=resource)

"""Deadline reminders: bands, candidates, messages, validation of rule sets.

Functions over rules take one set, or, with `by`, a table of many sets told apart by that column. One set is small by contract (MAX_RULES at most), so it is
broadcast for the band join; many sets are met by set and bin of the time left, with a shuffle that Spark plans.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import instants, rules, text

CYCLE_HOURS, MAX_RULES = 1, 1000
FIELDS = ("assignment", "course", "due", "due_date", "due_time", "remaining", "tz")
PREFIX = "assignment_due_"
SCHEMA = "id string, offset_seconds long, title_template string, body_template string"


class RuleError(ValueError):
    """A rule set that could not be delivered as it stands."""


@dataclass(frozen=True)
class Rule:
    id: str
    offset_seconds: int
    title_template: str = "{assignment}: {remaining}"
    body_template: str = "{course} - {due} ({tz})"


def rule_table(spark: SparkSession, given: Sequence[Rule]) -> DataFrame:
    if len(given) > MAX_RULES:
        raise RuleError(f"at most {MAX_RULES} rules")
    return spark.createDataFrame([(r.id, r.offset_seconds, r.title_template, r.body_template) for r in given], SCHEMA)


def _edges(rules_: DataFrame, by: str | None = None) -> DataFrame:
    """Rules with the lower end of their bands, within their set."""
    over = Window.partitionBy(*([by] if by else [])).orderBy("offset_seconds", "id")  # a rule set fits in one task
    return rules_.withColumn("lower", F.lag("offset_seconds", 1, 0).over(over))


def bands(rules_: DataFrame, by: str | None = None) -> DataFrame:
    """id, lower, upper of each rule's band (lower, upper], from the deadline outwards."""
    return _edges(rules_, by).select(*([by] if by else []), "id", "lower", F.col("offset_seconds").alias("upper"))


def narrowest_band(rules_: DataFrame, by: str | None = None) -> DataFrame:
    """Width of the tightest band: one row, 0 without rules; or a row for each set."""
    width = F.coalesce(F.min(F.col("upper") - F.col("lower")), F.lit(0)).cast("bigint").alias("narrowest")
    made = bands(rules_, by)
    return made.groupBy(by).agg(width) if by else made.agg(width)


def violations(rules_: DataFrame, by: str | None = None) -> DataFrame:
    """rule_id, problem for what is wrong with the numbers of a rule set; by set, from one pass over its rules in the order of their offsets."""
    own = [by] if by else []
    # Two sorts: by offset and id, which the bands need too, and by id and offset. A group has more than one row if its first row has a next one.
    each, alike, more = Window.partitionBy(*own, "id").orderBy("offset_seconds"), Window.partitionBy(*own, "offset_seconds").orderBy("id"), lambda w: F.lead(F.lit(True), 1, False).over(w)
    told = _edges(rules_, by).withColumns({"_first": F.row_number().over(alike), "_alike": more(alike)}).withColumns({"_nth": F.row_number().over(each), "_twice": more(each)})
    width = F.col("offset_seconds") - F.col("lower")
    found = {
        "duplicate id": F.col("_twice") & (F.col("_nth") == 1),
        "duplicate offset": F.col("_alike") & (F.col("_first") == 1),
        "not before the deadline": F.col("offset_seconds") <= 0,
        "band too narrow": width.between(1, CYCLE_HOURS * instants.HOUR - 1),
    }
    problems = F.filter(F.array(*(F.when(wrong, F.lit(problem)) for problem, wrong in found.items())), lambda x: x.isNotNull())
    return told.select(*own, F.col("id").alias("rule_id"), F.explode(problems).alias("problem"))


def validate(given: Sequence[Rule]) -> None:
    """Raises RuleError for a set that can't be delivered; the empty set is valid."""
    ids, offsets = [r.id for r in given], sorted(r.offset_seconds for r in given)
    if len(set(ids)) < len(ids):
        raise RuleError(f"duplicate id(s): {sorted({i for i in ids if ids.count(i) > 1})}")
    if len(set(offsets)) < len(offsets):
        raise RuleError("two rules share an offset")
    if offsets and offsets[0] <= 0:
        raise RuleError("a reminder must come before the deadline")
    for r in given:
        for template in (r.title_template, r.body_template):
            try:
                unknown = {name for slot, name in text.segments(template) if slot} - set(FIELDS)
            except ValueError as e:
                raise RuleError(f"{r.id}: {e}") from None
            if unknown:
                raise RuleError(f"{r.id}: unknown placeholder(s) {sorted(unknown)}")
    if offsets and min(b - a for a, b in zip([0, *offsets], offsets)) < CYCLE_HOURS * instants.HOUR:
        raise RuleError("bands must be at least one cycle wide")


def effective_rules(host: DataFrame, stored: DataFrame, saved: DataFrame, by: str | None = None) -> DataFrame:
    """The stored rules that are enabled, possibly none, once any set was saved; the host's until then. With `by`, that holds of each set; saved has the sets that were saved."""
    columns = [*([by] if by else []), "id", "offset_seconds", "title_template", "body_template"]
    own, theirs = stored.filter("enabled").select(*columns), host.select(*columns)
    if by:
        marks = saved.select(by).distinct()
        return own.join(marks, by, "left_semi").unionByName(theirs.join(marks, by, "left_anti"))
    marker = saved.agg((F.count("*") > 0).alias("_saved"))  # one row
    return own.join(F.broadcast(marker)).filter("_saved").select(*columns).unionByName(theirs.join(F.broadcast(marker)).filter("NOT _saved").select(*columns))


def _bin(seconds: Column) -> Column:
    """The binary digits of a time left, so that a band of any width lies in a few bins; 0 when it is over."""
    return F.when(seconds <= 0, 0).otherwise(F.length(F.bin(seconds)))


def in_band(tasks: DataFrame, rules_: DataFrame, now: int, due: str = "duedate", by: str | None = None) -> DataFrame:
    """Tasks with the rule (of their set: both have the column `by`) of the smallest offset that is not below the time left. Bands don't overlap, so each task meets one rule at most and nothing has to be aggregated; the narrowest band has no lower end.

    Met are only rules whose band lies in the bin of the time left, by an equal join.
    """
    own = [by] if by else []
    below = F.lag("offset_seconds").over(Window.partitionBy(*own).orderBy("offset_seconds", "id"))
    edges = rules_.select(*(F.col(c).alias(f"_{c}") for c in own), F.col("id").alias("rule_id"), below.alias("lower"), F.col("offset_seconds").alias("upper"), "title_template", "body_template")
    first = F.when(F.col("lower").isNull(), 0).otherwise(_bin(F.col("lower") + 1))
    b = edges.withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, _bin(F.col("upper"))))))
    left = F.col(due) - F.lit(now)
    met = (_bin(left) == F.col("_bin")) & (left <= F.col("upper")) & (F.col("lower").isNull() | (left > F.col("lower")))
    for c in own:
        met = (F.col(c) == F.col(f"_{c}")) & met
    return tasks.join(b if by else F.broadcast(b), met).drop("lower", "upper", "_bin", *(f"_{c}" for c in own))


def candidates(assignments: DataFrame, statuses: DataFrame, rules_: DataFrame, now: int, confirmed: str | None) -> DataFrame:
    """Pending assignments that the last successful sync saw, each with its rule and identity (notification_type, subject_key, scheduled_for).

    The widest band is the horizon. Without a successful sync nothing is confirmed, so there are none.
    """
    if confirmed is None:
        return candidates(assignments.limit(0), statuses, rules_, now, "")
    s = statuses.select(F.col("assignment_id").alias("_a"), "submission_status")
    seen = assignments.filter(F.col("last_synced_at") >= confirmed)
    rows = in_band(seen.join(s, seen.id == F.col("_a")).filter(rules.pending("duedate", "submission_status", now)), rules_, now)
    return rows.select(F.col("id").alias("assignment_id"), "course_id", "name", "duedate", "rule_id", "title_template", "body_template", (F.col("duedate") - F.lit(now)).alias("remaining_seconds"), F.concat(F.lit(PREFIX), "rule_id").alias("notification_type"), text.subject_key("id").alias("subject_key"), instants.iso("duedate").alias("scheduled_for"))


def unsent(found: DataFrame, sent: DataFrame) -> DataFrame:
    """Candidates not sent yet. A moved deadline is another identity, so it starts anew."""
    keys = ["notification_type", "subject_key", "scheduled_for"]
    return found.join(sent.select(*keys), keys, "left_anti")


def messages(found: DataFrame, courses: DataFrame, given: Sequence[Rule], zone: str = instants.ZONE) -> DataFrame:
    """notification_type, subject_key, scheduled_for, title, body: each candidate's text by its rule."""
    c = courses.select(F.col("id").alias("_c"), "fullname")
    rows = found.join(c, found.course_id == F.col("_c"), "left")
    due = instants.local("duedate", zone)
    context = {
        "assignment": F.col("name"),
        "course": F.coalesce("fullname", F.concat(F.lit("Curso "), F.col("course_id").cast("string"))),
        "due": F.date_format(due, "yyyy-MM-dd HH:mm"),
        "due_date": F.date_format(due, "yyyy-MM-dd"),
        "due_time": F.date_format(due, "HH:mm"),
        "remaining": instants.remaining_words("remaining_seconds"),
        "tz": F.lit(zone),
    }

    def chosen(part: str):
        made = F.lit(None).cast("string")
        for r in given:
            made = F.when(F.col("rule_id") == r.id, text.render(getattr(r, part), context)).otherwise(made)
        return made

    return rows.select("notification_type", "subject_key", "scheduled_for", chosen("title_template").alias("title"), chosen("body_template").alias("body"))

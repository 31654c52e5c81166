"""Execution history, manual requests, checkpoints, and what an operator asks about the store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import instants
from .latest import latest_by

OVERLAP_SECONDS = 300
DONE, FAILED, RUNNING = "done", "failed", "running"


def last_execution(executions: DataFrame, status: str | None = None) -> DataFrame:
    """Each job's last execution, at a status or at any."""
    rows = executions if status is None else executions.filter(F.col("status") == status)
    return latest_by(rows, ["job_name"], ["id"])


def last_successful_start(executions: DataFrame, job: str) -> DataFrame:
    """started_at of a job's last successful execution; no row when there is none."""
    done = executions.filter((F.col("job_name") == job) & (F.col("status") == DONE))
    return done.agg(F.max_by("started_at", "id").alias("started_at")).filter("started_at IS NOT NULL")


def asked_since(begun):
    """From when changes are asked for, in epoch seconds, if the last reading began at a time (a number or a column): a little earlier, as clocks differ."""
    return F.greatest(F.lit(0), begun - OVERLAP_SECONDS).cast("bigint") if isinstance(begun, Column) else max(0, begun - OVERLAP_SECONDS)


def checkpoint(executions: DataFrame, job: str, trigger: str) -> DataFrame:
    """One row, since: from when a sync has to ask for changes, in epoch seconds; null for everything."""
    started = executions.filter((F.col("job_name") == job) & (F.col("status") == DONE)).agg(F.max_by("started_at", "id").alias("s"))
    since = asked_since(instants.epoch_of_iso("s"))
    return started.select((F.lit(None).cast("bigint") if trigger == "startup" else F.when(F.col("s").isNotNull(), since)).alias("since"))


def recent_executions(executions: DataFrame, most: int = 10) -> DataFrame:
    return executions.orderBy(F.desc("id")).limit(most)


def running(executions: DataFrame) -> DataFrame:
    return executions.filter(F.col("status") == RUNNING)


def served_requests(requests: DataFrame, executions: DataFrame) -> DataFrame:
    """Requests whose job was still running, or ended, at or after they were made."""
    e = executions.select(F.col("job_name").alias("_j"), "finished_at")
    # Only each job's newest end matters, so a row for each job is joined instead of its history.
    newest = e.groupBy("_j").agg(F.max(F.coalesce("finished_at", F.lit("~"))).alias("_end"))
    return requests.join(newest, (requests.job_name == F.col("_j")) & (F.col("_end") >= requests.requested_at), "left_semi")


def waiting_requests(requests: DataFrame, executions: DataFrame) -> DataFrame:
    """Requests, with served: whether their job was running, or ended, after they were made, so that they need no run of their own."""
    done = served_requests(requests, executions).select("id").withColumn("served", F.lit(True))
    return requests.join(done, "id", "left").select(*requests.columns, F.coalesce("served", F.lit(False)).alias("served"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, n for each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sync_totals(counts: DataFrame) -> DataFrame:
    """counts (courses, changed, assignments, statuses, grades, events, detection_warnings, item_warnings, full) with items_processed and summary."""
    items = F.col("courses") + F.col("assignments") + F.col("statuses") + F.col("grades") + F.col("events")
    more = lambda c, what: F.when(F.col(c) > 0, F.concat(F.lit(", "), F.col(c).cast("string"), F.lit(what))).otherwise(F.lit(""))
    words = F.format_string("%s: %d/%d course(s) re-synced, %d assignment(s), %d status(es), %d grade item(s), %d event(s)", F.when(F.col("full"), "full").otherwise("incremental"), "changed", "courses", "assignments", "statuses", "grades", "events")
    return counts.select(items.cast("bigint").alias("items_processed"), F.concat(words, more("detection_warnings", " update-detection warning(s)"), more("item_warnings", " item warning(s)")).alias("summary"))


def batch_counters(results: DataFrame) -> DataFrame:
    """One row of a batch's results (seq, outcome, error): attempted, done, failed, deferred, first_error."""
    return results.agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("outcome") == "done").alias("done"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "too_large").alias("deferred"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("first_error"),
    )


def method_counts(extractions: DataFrame) -> DataFrame:
    """extractor_name, method, n of successful attempts."""
    return extractions.filter("status = 'done'").groupBy("extractor_name", F.get_json_object("metadata", "$.method").alias("method")).agg(F.count("*").alias("n"))


def error_counts(extractions: DataFrame) -> DataFrame:
    return extractions.filter("status = 'failed'").groupBy("error_reason").agg(F.count("*").alias("n"))


def storage_volume(versions: DataFrame) -> DataFrame:
    """One row: versions stored, and their whole megabytes."""
    return versions.agg(F.count("*").alias("versions"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).select("versions", F.expr("bytes div 1048576").alias("mb"))


def status_report(executions: DataFrame, requests: DataFrame, jobs: list[str]) -> DataFrame:
    """A row for each job: its last execution and last failure, whether it runs, and requests that wait."""
    last = last_execution(executions).select(F.col("job_name").alias("_l"), "status", "started_at", "trigger", "attempt", "items_processed", "detail")
    failure = last_execution(executions, FAILED).select(F.col("job_name").alias("_f"), F.col("started_at").alias("failed_at"), F.col("error").alias("last_error"))
    live = running(executions).groupBy(F.col("job_name").alias("_r")).agg(F.count("*").alias("n_running"))
    waits = requests.groupBy(F.col("job_name").alias("_w")).agg(F.count("*").alias("n_waiting"))
    names = executions.sparkSession.createDataFrame([(j,) for j in jobs], "job_name string")
    rows = names.join(last, F.col("job_name") == F.col("_l"), "left").join(failure, F.col("job_name") == F.col("_f"), "left").join(live, F.col("job_name") == F.col("_r"), "left").join(waits, F.col("job_name") == F.col("_w"), "left")
    return rows.select("job_name", "status", "started_at", "trigger", "attempt", "items_processed", "detail", "failed_at", "last_error", F.coalesce("n_running", F.lit(0)).alias("n_running"), F.coalesce("n_waiting", F.lit(0)).alias("n_waiting"))

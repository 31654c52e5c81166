"""Mutations as transitions between snapshots: new state = f(old state, batch). Files are never overwritten while they are read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.parts import dealt
from ..sources.scratch import written


def last_of_batch(batch: DataFrame, keys: Sequence[str], order: str = "_seq") -> DataFrame:
    """The last row of each key in a batch."""
    by = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return batch.withColumn("_nth", F.row_number().over(by)).filter("_nth = 1").drop("_nth", order)


def upsert(old: DataFrame, batch: DataFrame, keys: Sequence[str], now: str, keep: Sequence[str] = (), order: str = "_seq") -> DataFrame:
    """old with the batch's rows put in or over it, key by key; the last of a batch's rows for a key counts (by `order`).

    created_at is that of a key's first row, last_synced_at becomes now, and `keep` columns stay as they were where the key
    existed. Columns that the batch lacks stay too, null for new keys. One full outer join, co-partitioned on the keys.
    """
    new = last_of_batch(batch, keys, order).withColumn("_new", F.lit(True))
    new = new.select(*(F.col(c).alias(f"_b_{c}") for c in new.columns))
    was = old.withColumn("_old", F.lit(True))
    joined = was.join(new, [was[k] == F.col(f"_b_{k}") for k in keys], "full_outer")
    brought = F.col("_b__new").isNotNull()

    def value(c: str) -> Column:
        if c == "created_at":
            return F.when(F.col("_old").isNotNull(), F.col(c)).otherwise(F.lit(now))
        if c == "last_synced_at":
            return F.when(brought, F.lit(now)).otherwise(F.col(c))
        if f"_b_{c}" not in new.columns:
            return F.col(c)
        if c in keep:
            return F.when(F.col("_old").isNotNull(), F.col(c)).otherwise(F.col(f"_b_{c}"))
        return F.when(brought, F.col(f"_b_{c}")).otherwise(F.col(c))

    return joined.select(*(value(c).alias(c) for c in old.columns))


def with_ids(old: DataFrame, new: DataFrame, keys: Sequence[str], column: str = "id", last: int | None = None) -> DataFrame:
    """new rows with ids that follow the old ones (or `last`, if that is known), in the order of a hash of their keys.

    The hash's first three digits deal rows evenly to 4096 groups, which are numbered side by side; as these digits
    come first in the order too, a group's ids begin after those of the groups before it, of which there are 4096
    counts at most. The order depends on the keys alone, not on how rows are partitioned, so a task that is run again gives the same ids.
    """
    named = new.withColumn("_hash", F.sha2(F.concat_ws("\x1f", *(F.col(k).cast("string") for k in keys)), 256)).withColumn("_group", F.left("_hash", F.lit(3)))
    at = F.row_number().over(Window.partitionBy("_group").orderBy("_hash", *keys))
    sizes = named.groupBy("_group").agg(F.count("*").alias("_n"))
    before = sizes.select("_group", (F.sum("_n").over(Window.orderBy("_group")) - F.col("_n")).alias("_before"))
    if last is None:
        top = old.agg(F.coalesce(F.max(column), F.lit(0)).alias("_top"))
        before = before.join(F.broadcast(top))
    else:
        before = before.withColumn("_top", F.lit(last))
    starts = before.select("_group", (F.col("_top") + F.col("_before")).alias("_start"))
    made = named.withColumn("_at", at).join(F.broadcast(starts), "_group")
    return made.withColumn(column, (F.col("_start") + F.col("_at")).cast("bigint")).drop("_hash", "_group", "_at", "_start")


def upsert_with_ids(old: DataFrame, batch: DataFrame, keys: Sequence[str], now: str, order: str = "_seq", reserve: Callable[[int], int] | None = None) -> DataFrame:
    """upsert for a table whose id is given by the store: new keys get the next ids, or those that follow what reserve(how many) returns."""
    merged = upsert(old, batch, keys, now, order=order)
    known, fresh = merged.filter("id IS NOT NULL"), merged.filter("id IS NULL").drop("id")
    last = reserve(fresh.count()) if reserve else None
    return known.unionByName(with_ids(old, fresh, keys, last=last).select(*old.columns))


def insert_or_ignore(old: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the batch's rows of keys that it lacks, one for each."""
    fresh = batch.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def append(old: DataFrame, rows: DataFrame) -> DataFrame:
    return old.unionByName(rows.select(*old.columns))


def update(old: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """old with columns set where a condition holds; where it is unknown nothing changes."""
    hit = F.coalesce(condition, F.lit(False))
    return old.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(old: DataFrame, condition: Column) -> DataFrame:
    """old without the rows for which a condition holds; where it is unknown they stay."""
    return old.filter(~F.coalesce(condition, F.lit(False)))


def start_execution(executions: DataFrame, execution: int, job: str, trigger: str, attempt: int, at: str) -> DataFrame:
    """executions with the row of an attempt that begins."""
    row = executions.sparkSession.createDataFrame([(execution, job, trigger, attempt, "running", at)], "id long, job_name string, trigger string, attempt long, status string, started_at string")
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in executions.schema if f.name not in row.columns]
    return append(executions, row.select("*", *more))


def finish_execution(executions: DataFrame, execution: int, status: str, at: str, seconds: float, items: int | None = None, detail: str | None = None, error: str | None = None) -> DataFrame:
    values = {"status": status, "finished_at": at, "duration_seconds": seconds, "items_processed": items, "detail": detail, "error": error}
    return update(executions, F.col("id") == execution, **{c: F.lit(v).cast(executions.schema[c].dataType) for c, v in values.items()})


def fail_stale_running(executions: DataFrame, at: str, error: str) -> DataFrame:
    """Attempts that a former process left running, as failed. How many: count rows running before."""
    return update(executions, F.col("status") == "running", status=F.lit("failed"), finished_at=F.lit(at), error=F.lit(error))


def replace_rules(rules: Sequence, now: str, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The whole rule set and its marker, anew; validated first, so nothing is replaced by a set that can't be delivered."""
    from .reminders import validate

    validate(rules)
    stored = spark.createDataFrame([(r.id, r.offset_seconds, True, r.title_template, r.body_template, now) for r in rules], "id string, offset_seconds long, enabled boolean, title_template string, body_template string, updated_at string")
    return stored, spark.createDataFrame([(1, now)], "id long, saved_at string")


def replace_rule_sets(stored: DataFrame, brought: DataFrame, now: str, by: str) -> DataFrame:
    """stored rules after sets were brought anew (by, id, offset_seconds, templates): each that can be delivered takes the place of the whole stored set; one that can't changes nothing."""
    from .reminders import violations

    # Both are dealt out by set for as many rows, and what is found about sets is written down, so that a task sorts one or two bounded parts at a time.
    rows = stored.count() + brought.count()
    stored, brought = dealt(stored, rows, by), dealt(brought, rows, by)
    unsound = written(violations(brought, by).select(by).distinct(), "unsound")
    sound = brought.join(dealt(unsound, rows, by), by, "left_anti")
    replaced = written(sound.select(by).distinct(), "replaced")
    kept = stored.join(dealt(replaced, rows, by), by, "left_anti")
    return kept.unionByName(sound.select(by, "id", "offset_seconds", F.lit(True).alias("enabled"), "title_template", "body_template", F.lit(now).alias("updated_at")))


def record_outcomes(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch's results (resource_id, outcome done, too_large or failed, size_bytes, limit_bytes, source_timemodified, at) as: checks to
    put in, resources whose deferral ends, deferrals to put in. A plain failure leaves no trace, so it is tried again."""
    done, big = results.filter("outcome = 'done'"), results.filter("outcome = 'too_large'")
    return done.select("resource_id", "source_timemodified", F.col("at").alias("checked_at")), done.select("resource_id"), big.select("resource_id", F.lit("too_large").alias("reason"), "size_bytes", "limit_bytes", "source_timemodified", F.col("at").alias("deferred_at"))


def deferrals_after(deferrals: DataFrame, cleared: DataFrame, deferred: DataFrame) -> DataFrame:
    """deferrals without those that ended, with the new ones, which take the place of a resource's former one."""
    gone = cleared.select("resource_id").union(deferred.select("resource_id"))
    return deferrals.join(gone, "resource_id", "left_anti").select(*deferrals.columns).unionByName(deferred)

"""The reminder cycle as a streaming query: each micro-batch is one cycle, and what was sent is durable state."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reminders
from ..operators.history import last_successful_start
from ..sources import outbox
from ..sources.outbox import IDENTITY
from ..sources.sinks import Sink
from ..sources.warehouse import Warehouse

SYNC = "moodle_sync"
#: Failures of a cycle that the log tells of one by one.
LOGGED = 20
log = logging.getLogger(__name__)


def send_cycle(warehouse: Warehouse, rules: Iterable[reminders.Rule], now: int, confirmed: str | None, sink: Sink, at: str, should_stop: Callable[[], bool] = lambda: False) -> dict:
    """Sends what is due and not sent yet, on the executors, and records what the receipts say was sent, so a failure is tried again (at least once). A stop is heard before the cycle sends anything."""
    spark, rules = warehouse.spark, list(rules)
    found = reminders.candidates(warehouse["assignments"], warehouse["submissions"], reminders.rule_table(spark, rules), now, confirmed)
    due = reminders.messages(reminders.unsent(found, warehouse["sent"]), warehouse["courses"], rules)
    with warehouse.aside() as keep:
        due = keep(due)  # a lost task sends the same messages again, not others that have become due meanwhile
        if should_stop() or due.isEmpty():
            return {"pending": 0, "sent": 0, "failed": 0, "first_error": None}
        path = keep.path()
        try:
            told = outbox.send(due, sink, path)
        finally:  # what tasks sent before another one broke the cycle is not sent again
            record(warehouse, outbox.receipts(due, path).filter("error IS NULL").select(*IDENTITY, F.lit(at).alias("sent_at")))
        row = told.agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.min_by("error", F.struct(F.col("error").isNull(), *IDENTITY)).alias("first")).first()
        for r in told.filter("error IS NOT NULL").limit(LOGGED).collect():
            log.warning("%s for %s was not sent: %s", r.notification_type, r.subject_key, r.error)
    return {"pending": row.n, "sent": row.n - row.failed, "failed": row.failed, "first_error": row.first}


def record(warehouse: Warehouse, rows: DataFrame) -> None:
    """Adds sent messages that are not recorded yet; recording a batch again changes nothing."""
    from ..operators.state import insert_or_ignore, with_ids
    from ..sources.schema import empty

    fresh = rows.dropDuplicates(IDENTITY).join(warehouse.find("sent", rows).select(*IDENTITY), IDENTITY, "left_anti")
    if n := fresh.count():
        none = empty(warehouse.spark, "sent")
        warehouse.commit(append={"sent": insert_or_ignore(none, with_ids(none, fresh, IDENTITY, last=warehouse.reserve("sent", n)), IDENTITY)})


def start(ticks: DataFrame, warehouse: Warehouse, rules_source: Callable[[], Iterable[reminders.Rule]], sink: Sink, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A streaming query over ticks (now long, confirmed string, at string): each batch evaluates its newest tick only, so missed ones are skipped, not replayed.

    Rules are read anew for every batch, and so is the start of the last successful sync where a tick has none.
    """

    def cycle(batch: DataFrame, _: int) -> None:
        if newest := batch.orderBy("now", ascending=False).first():
            confirmed = newest.confirmed
            if confirmed is None and (last := last_successful_start(warehouse["executions"], SYNC).first()):
                confirmed = last.started_at
            send_cycle(warehouse, rules_source(), newest.now, confirmed, sink, newest.at)

    return ticks.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hourly(spark: SparkSession) -> DataFrame:
    """Ticks of the clock on the hour, from the rate source."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return rate.selectExpr("unix_seconds(timestamp) AS now", "CAST(NULL AS string) AS confirmed", "CAST(timestamp AS string) AS at").filter("now % 3600 = 0")

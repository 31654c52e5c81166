"""Course contents that follow the platform's changes: a streaming query from the change feed into the warehouse."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize, state
from ..sources.warehouse import Warehouse


def apply(warehouse: Warehouse, changes: DataFrame, fetch: Callable[[str, DataFrame], DataFrame], at: str) -> int:
    """Reads the contents of courses that changed (or are new) again and puts them over the stored rows, in one commit; how many courses. By key, so that a batch that is done again changes nothing."""
    changed = changes.filter("since IS NULL OR n_instances + n_warnings > 0").select("course_id").distinct()
    with warehouse.aside() as keep:
        changed = keep(changed)
        if not (n := changed.count()):
            return 0
        told = fetch("contents", changed.select(F.to_json(F.struct(F.col("course_id").alias("courseid"))).alias("params")))
        contents = keep(told.select(F.get_json_object("params", "$.courseid").cast("bigint").alias("course_id"), "payload"))
        numbered = {name: keep(made(contents)).withColumn("_seq", F.monotonically_increasing_id()) for name, made in (("sections", normalize.sections), ("modules", normalize.modules), ("files", normalize.files))}
        put = {name: state.upsert(warehouse.find(name, numbered[name]), numbered[name], ["id"], at) for name in ("sections", "modules")}
        files = state.upsert_with_ids(warehouse.find("files", numbered["files"]), numbered["files"], ["fileurl"], at, reserve=lambda n: warehouse.reserve("files", n))
        warehouse.commit(put={**put, "files": keep(files)})
    return n


def start(changes: DataFrame, warehouse: Warehouse, fetch: Callable[[str, DataFrame], DataFrame], checkpoint: str, trigger: dict | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> StreamingQuery:
    """The query; after a restart it asks from where its checkpoint says, so nothing is lost, and what is told again is put over itself."""

    def batch(rows: DataFrame, _: int) -> None:
        apply(warehouse, rows, fetch, now().isoformat())

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

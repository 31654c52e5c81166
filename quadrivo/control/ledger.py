"""The history of attempts and the requests of other processes: in the warehouse, or in memory."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import functions as F

from ..operators import history, state
from ..sources import schema
from ..sources.warehouse import Warehouse

ABANDONED = "interrupted: its process ended without closing it"


@dataclass(frozen=True)
class Result:
    items: int = 0
    detail: str | None = None
    error: str | None = None


class Ledger(Protocol):
    def begin(self, job: str, trigger: str, attempt: int, at: str) -> int: ...
    def end(self, entry: int, status: str, at: str, seconds: float, result: Result) -> None: ...
    def fail_open(self, at: str) -> int: ...
    def last_status(self, job: str) -> str | None: ...
    def take_requests(self) -> list[tuple[str, bool]]: ...
    def drop_requests(self) -> int: ...


@dataclass
class WarehouseLedger:
    """Rows of executions are added and closed one at a time, by the transitions that queries test: each is a small part of the table's log, under an id that was set aside for it."""

    warehouse: Warehouse

    def begin(self, job: str, trigger: str, attempt: int, at: str) -> int:
        w = self.warehouse
        entry = 1 + w.reserve("executions", 1)
        w.commit(append={"executions": state.start_execution(schema.empty(w.spark, "executions"), entry, job, trigger, attempt, at)})
        return entry

    def end(self, entry: int, status: str, at: str, seconds: float, result: Result) -> None:
        w = self.warehouse
        row = w.find("executions", w.spark.createDataFrame([(entry,)], "id long"))
        items = result.items if status == "done" else None
        w.commit(put={"executions": state.finish_execution(row, entry, status, at, seconds, items, result.detail, result.error)})

    def fail_open(self, at: str) -> int:
        rows = history.running(self.warehouse["executions"])
        if n := rows.count():
            self.warehouse.commit(put={"executions": state.fail_stale_running(rows, at, ABANDONED)})
        return n

    def last_status(self, job: str) -> str | None:
        last = history.last_execution(self.warehouse["executions"].filter(F.col("job_name") == job)).first()
        return last and last.status

    def take_requests(self) -> list[tuple[str, bool]]:
        """The jobs that other processes asked for, in order, and whether a run since then has served them; they are removed."""
        files = self.warehouse.request_files()
        if not files:
            return []
        rows = history.waiting_requests(self.warehouse.requests(files), self.warehouse["executions"])
        found = [(r.job_name, r.served) for r in rows.orderBy("requested_at", "id").collect()]  # what people asked for within a few seconds
        self.warehouse.remove_requests(files)
        return found

    def drop_requests(self) -> int:
        return self.warehouse.remove_requests(self.warehouse.request_files())


@dataclass
class MemoryLedger:
    """The same without a warehouse. requests: job and when it was asked for."""

    rows: list[dict] = field(default_factory=list)
    requests: list[tuple[str, str]] = field(default_factory=list)

    def begin(self, job: str, trigger: str, attempt: int, at: str) -> int:
        self.rows.append({"job": job, "trigger": trigger, "attempt": attempt, "started_at": at, "status": "running", "finished_at": None})
        return len(self.rows) - 1

    def end(self, entry: int, status: str, at: str, seconds: float, result: Result) -> None:
        self.rows[entry] |= {"status": status, "finished_at": at, "seconds": seconds, "items": result.items, "detail": result.detail, "error": result.error}

    def fail_open(self, at: str) -> int:
        left = [r for r in self.rows if r["status"] == "running"]
        for r in left:
            r |= {"status": "failed", "finished_at": at, "error": ABANDONED}
        return len(left)

    def last_status(self, job: str) -> str | None:
        return next((r["status"] for r in reversed(self.rows) if r["job"] == job), None)

    def take_requests(self) -> list[tuple[str, bool]]:
        taken, self.requests = self.requests, []
        return [(job, any(r["job"] == job and (r["finished_at"] is None or r["finished_at"] >= at) for r in self.rows)) for job, at in taken]

    def drop_requests(self) -> int:
        n, self.requests = len(self.requests), []
        return n

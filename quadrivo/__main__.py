"""Command line: python -m quadrivo CONFIG [--job NAME | --status | --backup | --purge [--yes]]; without an option, the daemon. Beside a daemon, --job
leaves the job to it.

Exit codes: 0 done, 1 failed or refused, 2 bad configuration or usage, 130 interrupted.
"""

from __future__ import annotations

import argparse
import logging
import os
import signal
import sys
from datetime import UTC, datetime
from pathlib import Path

from .control import config as configs
from .control.ledger import WarehouseLedger
from .control.scheduler import Scheduler


def build(conf: configs.Config, spark, base: str, token: str) -> Scheduler:
    from .control import jobs
    from .sources import platform, sinks
    from .sources.warehouse import Warehouse

    w, objects = Warehouse(spark, conf.warehouse), f"{conf.warehouse}/objects"
    fetch = lambda function, params: platform.calls(spark, base, token, function, params)
    sink = sinks.choose()
    now = lambda: datetime.now(UTC).isoformat()
    made = {
        configs.SYNC: jobs.SyncJob(w, conf, fetch),
        configs.INGESTION: jobs.IngestionJob(w, conf, objects, lambda urls: platform.downloads(urls, base, token)),
        configs.EXTRACTION: jobs.ExtractionJob(w, conf, objects),
        configs.NOTIFICATIONS: jobs.NotificationJob(w, conf, sink, jobs.status_refresh(w, fetch, now)),
    }
    alert = lambda job, error, at: sink.send(sinks.Message(sinks.JOB_FAILED, f"{job} failed", f"{at:%Y-%m-%d %H:%M}: {error}"))
    return Scheduler(made, conf, WarehouseLedger(w), alert)


def status(conf: configs.Config, spark) -> None:
    from .control.lease import Lease
    from .operators import history, queues, reminders
    from .sources.warehouse import Warehouse

    w = Warehouse(spark, conf.warehouse)
    print(f"Scheduler: {'running' if Lease(w).taken() else 'not running'}")
    for r in history.status_report(w["executions"], w["requests"], list(configs.JOBS)).collect():
        print(f"[{r.job_name}] enabled={conf.is_enabled(r.job_name)} last={r.status} at {r.started_at} ({r.trigger}, items={r.items_processed}) {r.detail or ''}" + (f" last failure {r.failed_at}: {r.last_error}" if r.last_error else ""))
    for r in reminders.bands(reminders.rule_table(spark, conf.reminders)).collect():
        print(f"reminder {r.id}: when {r.lower // 3600}h to {r.upper // 3600}h remain")
    for r in queues.listed_deferrals(w["deferrals"], w["resources"]).orderBy("size_bytes", ascending=False).toLocalIterator():
        print(f"not ingested: {r.name} ({r.reason}, {r.size_bytes} bytes, limit {r.limit_bytes})")
    for r in queues.abandoned_versions(w["versions"], w["resources"], w["extractions"]).orderBy("failures", ascending=False).toLocalIterator():
        print(f"given up: {r.name} after {r.failures} attempts: {r.last_error}")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("quadrivo", description=__doc__)
    parser.add_argument("config", type=Path)
    what = parser.add_mutually_exclusive_group()
    what.add_argument("--job", choices=configs.JOBS)
    what.add_argument("--status", action="store_true")
    what.add_argument("--purge", action="store_true")
    what.add_argument("--backup", action="store_true")
    parser.add_argument("--yes", action="store_true")
    given = parser.parse_args(args)
    try:
        conf = configs.parse(given.config.read_text())
    except (OSError, ValueError) as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .control.lease import Held, Lease
    from .sources.warehouse import Warehouse

    spark = SparkSession.builder.appName("quadrivo").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.status:
        status(conf, spark)
        return 0
    w = Warehouse(spark, conf.warehouse)
    try:
        with Lease(w):
            return work(conf, spark, w, given)
    except Held:
        if given.job:
            w.ask(given.job, datetime.now(UTC).isoformat(timespec="microseconds"))
            print(f"{given.job} is left to the process that runs on this warehouse")
            return 0
        print("another process runs on this warehouse", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


def work(conf: configs.Config, spark, w, given: argparse.Namespace) -> int:
    """What was asked for, by the process that has the warehouse."""
    from .sources.sinks import guard

    if given.backup:
        print(w.backup(f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}"))
        return 0
    if given.purge:
        if not given.yes:
            print("add --yes to empty the academic tables after a backup", file=sys.stderr)
            return 1
        for r in w.purge(f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}").collect():
            print(f"{r.table_name}: {r.n} row(s) removed")
        return 0
    logging.basicConfig(level=logging.INFO)
    guard(logging.getLogger())
    run = build(conf, spark, os.environ.get("MOODLE_URL", ""), os.environ.get("MOODLE_TOKEN", ""))
    for name in (signal.SIGINT, signal.SIGTERM):
        before = signal.getsignal(name)
        signal.signal(name, lambda *_, n=name, b=before: (run.stop(), signal.signal(n, b)))
    run.open(daemon=not given.job)
    if given.job:
        run.ask(given.job)
        run.drain()
        return 0 if run.ledger.last_status(given.job) == "done" else 1
    run.serve()
    return 0


if __name__ == "__main__":
    sys.exit(main())

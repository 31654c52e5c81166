"""The four jobs: each is one DataFrame program from a warehouse and its inputs to a new state.

`fetch(function, params)` gives a DataFrame of params and payload (JSON text) for parameter objects, a short list or a table of them; `download(urls)` one of
url, outcome, size_bytes, content, error. Both default to the platform's interface and run on the executors.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction, history, normalize, queues, state
from ..operators.latest import latest_versions
from ..operators.reminders import Rule
from ..sources import schema, warehouse as originals
from ..sources.sinks import Sink, safe_error
from ..sources.warehouse import Warehouse
from .config import EXTRACTION, INGESTION, SYNC, Config
from .ledger import Result
from .scheduler import Trigger

Fetch = Callable[[str, list[dict] | DataFrame], DataFrame]
DEPTH = "basic"
#: Items of a batch that are worked on and committed together; a stop and the time limit are heard between.
CHUNK = 25
log = logging.getLogger(__name__)


class Stopped(RuntimeError):
    pass


def _now() -> datetime:
    return datetime.now(UTC)


@dataclass
class Base:
    warehouse: Warehouse
    config: Config
    clock: Callable[[], datetime] = field(default=_now, kw_only=True)
    monotonic: Callable[[], float] = field(default=time.monotonic, kw_only=True)
    chunk: int = field(default=CHUNK, kw_only=True)

    def stamp(self) -> str:
        return self.clock().astimezone(UTC).isoformat()

    def empty(self, table: str) -> DataFrame:
        return schema.empty(self.warehouse.spark, table)

    def chunks(self, work: DataFrame, order: list[str], job: str, should_stop: Callable[[], bool]) -> Iterator[DataFrame]:
        """Pieces of a batch in order, until its items or its seconds are used up, or a stop is asked for. work has to be written down, as it is taken from piece by piece."""
        limits, began = self.config.jobs[job], self.monotonic()
        listed = work.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
        with self.warehouse.aside() as keep:
            listed, after, left = keep(listed), -1, limits.max_items
            while (left is None or left > 0) and not should_stop() and (limits.max_seconds is None or self.monotonic() - began < limits.max_seconds):
                piece = keep(listed.filter(F.col("_place") > after).orderBy("_place").limit(min(self.chunk, left or self.chunk)))
                n, last = piece.agg(F.count("*"), F.max("_place")).first()
                if not n:
                    break
                after, left = last, left and left - n
                yield piece.drop("_place")


@dataclass
class SyncJob(Base):
    """Reads the platform and puts what it returns over the stored rows. After the first run only courses with updates, warnings or no contents are read again."""

    fetch: Fetch = None

    def has_work(self) -> bool:
        return True

    def run(self, trigger: Trigger, should_stop: Callable[[], bool]) -> Result:
        with self.warehouse.aside() as keep:
            made = self._run(trigger, should_stop, keep)
        self.warehouse.vacuum()
        return made

    def _run(self, trigger: Trigger, should_stop: Callable[[], bool], keep: Callable[[DataFrame], DataFrame]) -> Result:
        """keep writes a payload down, so that it is fetched once, however often it is used. A stop is heard before each kind of payload; nothing is stored then,
        and the attempt counts as failed, so that the next one asks for the same changes."""
        w, now, spark = self.warehouse, self.stamp(), self.warehouse.spark

        def kept(df: DataFrame) -> DataFrame:
            if should_stop():
                raise Stopped("a stop was asked for; nothing is stored")
            return keep(df)

        since = history.checkpoint(w["executions"], SYNC, trigger.value).first().since
        user = kept(normalize.user(self.fetch("site_info", [{}])))
        me = user.first().id
        courses = kept(normalize.courses(self.fetch("courses", [{"userid": me}])))
        ids = sorted(r.id for r in courses.select("id").collect())  # the courses of one student
        lists = [self.fetch("timeline", [{"classification": name}]).select(F.explode(F.from_json(F.get_json_object("payload", "$.courses"), "array<struct<id:long>>")["id"]).alias("id")) for name in ("inprogress", "past", "future")]
        labels = queues.labelled_timeline(*lists)
        updates = spark.createDataFrame([], "course_id long, n_instances long, n_warnings long")
        if since is not None and ids:
            told = self.fetch("updates", _params(courses, courseid="id", since=F.lit(since)))
            size = lambda part: F.coalesce(F.json_array_length(F.get_json_object("payload", f"$.{part}")), F.lit(0)).cast("bigint")
            updates = told.select(F.get_json_object("params", "$.courseid").cast("bigint").alias("course_id"), size("instances").alias("n_instances"), size("warnings").alias("n_warnings"))
        changed = kept(queues.changed_courses(courses, w["sections"], kept(updates), since is None))
        contents = kept(self.fetch("contents", _params(changed, courseid="id")).select(F.get_json_object("params", "$.courseid").cast("bigint").alias("course_id"), "payload"))
        assignments = kept(normalize.assignments(self.fetch("assignments", [{"courseids": ids}])))
        refresh = queues.status_refresh(assignments, changed.select("id"), queues.needs_status(state.upsert(w["assignments"], _numbered(assignments), ["id"], now), w["submissions"], int(self.clock().timestamp())))
        wanted = kept(refresh)
        statuses = normalize.submission_status(self.fetch("submission", _params(wanted, assignid="id")).select(F.get_json_object("params", "$.assignid").cast("bigint").alias("assignment_id"), "payload"))
        statuses = kept(statuses)
        grades = kept(normalize.grades(self.fetch("grades", _params(changed, courseid="id", userid=F.lit(me)))))
        calendar = kept(normalize.calendar(self.fetch("calendar", [{"courseids": ids}])))
        # Only rows of the batches' keys are read and written; labels may be of courses that are stored, but not among those told now.
        touched = courses.select("id").union(labels.select("id"))
        merged_courses = state.upsert(w.find("courses", touched), _numbered(courses), ["id"], now).join(labels.withColumnRenamed("timeline_classification", "_label"), "id", "left")
        merged_courses = merged_courses.withColumn("timeline_classification", F.coalesce("_label", "timeline_classification"))
        files = kept(normalize.files(contents))
        w.commit(put={
            "users": self.merged("users", user, ["id"], now),
            "courses": merged_courses,
            "sections": self.merged("sections", normalize.sections(contents), ["id"], now),
            "modules": self.merged("modules", normalize.modules(contents), ["id"], now),
            "files": keep(state.upsert_with_ids(w.find("files", files), _numbered(files), ["fileurl"], now, reserve=lambda n: w.reserve("files", n))),
            "assignments": self.merged("assignments", assignments, ["id"], now),
            "submissions": self.merged("submissions", statuses, ["assignment_id"], now),
            "grades": self.merged("grades", grades, ["id"], now),
            "calendar": self.merged("calendar", calendar, ["id"], now),
        })
        counts = spark.createDataFrame([(since is None, len(ids), changed.count(), assignments.count(), wanted.count(), grades.count(), calendar.count(), 0, 0)], "full boolean, courses long, changed long, assignments long, statuses long, grades long, events long, detection_warnings long, item_warnings long")
        total = history.sync_totals(counts).first()
        return Result(total.items_processed, total.summary)

    def merged(self, table: str, batch: DataFrame, keys: list[str], now: str) -> DataFrame:
        """The rows of the batch's keys, as they are put over the stored ones."""
        return state.upsert(self.warehouse.find(table, batch), _numbered(batch), keys, now)


def _params(rows: DataFrame, **columns) -> DataFrame:
    """A column params: a call's parameters from each row."""
    return rows.select(F.to_json(F.struct(*((F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))).alias("params"))


def _numbered(batch: DataFrame) -> DataFrame:
    return batch.withColumn("_seq", F.monotonically_increasing_id())


@dataclass
class IngestionJob(Base):
    """Downloads what is pending, within its budget, and adds a version wherever the bytes are new. An item's failure is its own."""

    objects: str = ""
    download: Callable[[DataFrame], DataFrame] = None
    reserve: int = originals.RESERVE

    def pending(self) -> DataFrame:
        w = self.warehouse
        found = queues.descriptors(w["files"], w["modules"], w["sections"])
        return queues.ingestion_pending(found, w["resources"], w["versions"], w["checks"], w["deferrals"])

    def has_work(self) -> bool:
        return bool(self.pending().take(1))

    def run(self, trigger: Trigger, should_stop: Callable[[], bool]) -> Result:
        every = self.pending()
        n, told = every.count(), {"attempted": 0, "failed": 0, "deferred": 0, "new": 0, "first_error": None}
        for work in self.chunks(every, ["work_group", "second_key", "external_reference"], INGESTION, should_stop):
            for name, value in self.ingest(work).items():
                told[name] = told[name] + value if name != "first_error" else told[name] or value
        return Result(told["attempted"], f"{told['new']} new version(s), {told['deferred']} deferred, {n - told['attempted']} still pending", f"{told['failed']} item(s) failed; first: {told['first_error']}" if told["failed"] else None)

    def ingest(self, work: DataFrame) -> dict:
        """Downloads and commits one piece of the batch."""
        w, now, keys = self.warehouse, self.stamp(), ["origin", "source_type", "external_reference"]
        brought = _numbered(work.drop("work_group", "second_key", "latest_version_id", "mimetype", "source_timemodified"))
        w.commit(put={"resources": state.upsert_with_ids(w.find("resources", work), brought, keys, now, reserve=lambda n: w.reserve("resources", n))})
        work = work.join(w.find("resources", work).select(*keys, F.col("id").alias("resource_id")), keys)
        plain = work.filter("source_type = 'url'").select("resource_id", F.lit("done").alias("outcome"), F.length(queues.url_bytes("source_url")).cast("bigint").alias("size_bytes"), queues.url_bytes("source_url").alias("content"), F.lit(None).cast("string").alias("error"))
        files = work.filter("source_type = 'file'").select("resource_id", F.col("source_url").alias("fileurl"))
        got = self.download(files).join(files, F.col("url") == F.col("fileurl")).select("resource_id", "outcome", "size_bytes", "content", "error")
        with w.aside() as keep:
            results = keep(plain.unionByName(got).join(work.select("resource_id", "source_type", "mimetype", "source_timemodified"), "resource_id"))
            originals.store(results.filter("outcome = 'done'").select("content"), self.objects, reserve=self.reserve)
            last = latest_versions(w.find("versions", results)).select("resource_id", F.col("content_hash").alias("_was"), F.col("version_number").alias("_n"))
            hashed = results.filter("outcome = 'done'").withColumn("content_hash", F.sha2("content", 256)).join(last, "resource_id", "left")
            fresh = hashed.filter(~F.col("content_hash").eqNullSafe(F.col("_was")))
            rows = fresh.select("resource_id", (F.coalesce("_n", F.lit(0)) + 1).cast("bigint").alias("version_number"), "content_hash", F.concat(F.left("content_hash", F.lit(2)), F.lit("/"), "content_hash").alias("storage_ref"), "size_bytes", queues.default_mimetype("source_type", "mimetype").alias("mimetype"), F.lit(now).alias("ingested_at"))
            rows = keep(rows)
            new = rows.count()
            versions = state.with_ids(schema.empty(w.spark, "versions"), rows, ["resource_id"], last=w.reserve("versions", new))
            outcomes = results.select("resource_id", "outcome", "size_bytes", F.lit(64 << 20).cast("bigint").alias("limit_bytes"), "source_timemodified", F.lit(now).alias("at"))
            checks, cleared, deferred = state.record_outcomes(outcomes)
            told = history.batch_counters(results.withColumn("seq", F.col("resource_id"))).first().asDict()
            w.commit(append={"versions": versions}, drop={"deferrals": cleared}, put={"checks": checks, "deferrals": deferred})
        return {"attempted": told["attempted"], "failed": told["failed"], "deferred": told["deferred"], "new": new, "first_error": told["first_error"]}


@dataclass
class ExtractionJob(Base):
    """Reads the text of pending versions, within its budget, and records every attempt."""

    objects: str = ""

    def pending(self) -> DataFrame:
        return queues.pending_extraction(self.warehouse["versions"], self.warehouse["extractions"], DEPTH)

    def has_work(self) -> bool:
        return bool(self.pending().take(1))

    def run(self, trigger: Trigger, should_stop: Callable[[], bool]) -> Result:
        every = self.pending()
        n, told = every.count(), {"attempted": 0, "done": 0, "failed": 0, "first_error": None}
        for work in self.chunks(self.described(every), ["failed_count", "id"], EXTRACTION, should_stop):
            for name, value in self.extract(work).items():
                told[name] = told[name] + value if name != "first_error" else told[name] or value
        return Result(told["attempted"], f"{told['done']} done, {told['failed']} failed, {n - told['attempted']} still pending", told["first_error"])

    def described(self, pending: DataFrame) -> DataFrame:
        """Pending versions with what their extraction needs to know of them, looked up once for the whole batch."""
        from ..functions.text import extension

        w = self.warehouse
        names = w["resources"].select(F.col("id").alias("resource_id"), "name")
        how = extraction.extractor("mimetype", extension("name"), pictures="image_ocr" in extraction.PARSERS).alias("extractor_name")
        return pending.join(w["versions"], "id").join(names, "resource_id", "left").select("id", "failed_count", "content_hash", how)

    def extract(self, rows: DataFrame) -> dict:
        """Reads and records one piece of the batch."""
        w, now = self.warehouse, self.stamp()
        rows = rows.select(F.col("id").alias("resource_version_id"), "content_hash", "extractor_name")
        content = originals.retrieve(w.spark, self.objects, rows.select("content_hash").distinct())
        with w.aside() as keep:
            made = keep(extraction.extract(rows.join(content, "content_hash", "left").drop("content_hash")))
            added = made.select("*", F.lit(DEPTH).alias("depth"), F.lit(now).alias("extracted_at"))
            told = history.batch_counters(made.select(F.col("resource_version_id").alias("seq"), F.col("status").alias("outcome"), F.col("error_reason").alias("error"))).first().asDict()
            none = schema.empty(w.spark, "extractions")
            w.commit(append={"extractions": state.append(none, state.with_ids(none, added, ["resource_version_id"], last=w.reserve("extractions", told["attempted"])))})
        return {name: told[name] for name in ("attempted", "done", "failed", "first_error")}


@dataclass
class NotificationJob(Base):
    """Sends reminders that are due. What the last successful sync did not see is not reminded of."""

    sink: Sink = None
    refresh: Callable[[DataFrame], None] | None = None

    def rules(self) -> list[Rule]:
        """The rules in force, read anew each time: those saved, else the configured ones."""
        w = self.warehouse
        if not w["rules_saved"].take(1):
            return list(self.config.reminders)
        return [Rule(r.id, r.offset_seconds, r.title_template, r.body_template) for r in w["rules"].filter("enabled").collect()]

    def confirmed(self) -> str | None:
        last = history.last_successful_start(self.warehouse["executions"], SYNC).first()
        return last.started_at if last else None

    def candidates(self) -> DataFrame:
        from ..operators import reminders

        w = self.warehouse
        found = reminders.candidates(w["assignments"], w["submissions"], reminders.rule_table(w.spark, self.rules()), int(self.clock().timestamp()), self.confirmed())
        return reminders.unsent(found, w["sent"])

    def has_work(self) -> bool:
        return bool(self.candidates().take(1))

    def run(self, trigger: Trigger, should_stop: Callable[[], bool]) -> Result:
        from ..streaming.reminders import send_cycle

        with self.warehouse.aside() as keep:
            return self._run(keep(self.candidates().select("assignment_id").distinct()), send_cycle, should_stop)

    def _run(self, before: DataFrame, send_cycle: Callable, should_stop: Callable[[], bool]) -> Result:
        n = before.count()
        if self.refresh and n:
            try:
                self.refresh(before)  # a submission made meanwhile stops its reminder
            except Exception as e:  # noqa: BLE001 - an outage of the platform must not silence reminders: the stored statuses stand in
                log.warning("statuses could not be read again, the stored ones are used: %s", safe_error(e))
        made = send_cycle(self.warehouse, self.rules(), int(self.clock().timestamp()), self.confirmed(), self.sink, self.stamp(), should_stop)
        suppressed = n - made["pending"]
        return Result(made["sent"], f"{made['sent']} sent, {made['failed']} failed, {suppressed} no longer due", made["first_error"])


def status_refresh(warehouse: Warehouse, fetch: Fetch, now: Callable[[], str]) -> Callable[[DataFrame], None]:
    """Reads the submission status of assignments (column assignment_id) again and stores it."""

    def refresh(assignments: DataFrame) -> None:
        got = fetch("submission", _params(assignments, assignid="assignment_id"))
        rows = normalize.submission_status(got.select(F.get_json_object("params", "$.assignid").cast("bigint").alias("assignment_id"), "payload"))
        with warehouse.aside() as keep:
            rows = keep(rows)
            warehouse.commit(put={"submissions": state.upsert(warehouse.find("submissions", rows), _numbered(rows), ["assignment_id"], now())})

    return refresh


def recorded(spark, payloads: dict[str, dict]) -> Fetch:
    """A fetch that answers from recorded payloads: function to {parameters as sorted JSON: payload}; "*" answers all others."""

    def fetch(function: str, params: list[dict] | DataFrame) -> DataFrame:
        answers = payloads.get(function, {})
        given = [json.loads(r.params) for r in params.toLocalIterator()] if isinstance(params, DataFrame) else params
        rows = [(json.dumps(p), json.dumps(answers.get(json.dumps(p, sort_keys=True), answers.get("*", {})))) for p in given]
        return spark.createDataFrame(rows, "params string, payload string")

    return fetch

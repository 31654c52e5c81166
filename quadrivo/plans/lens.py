"""The logical tables, derived from the driver's test tables by one SQL text for each, in Spark's and DuckDB's dialect.

$name stands for another table. The test data have no nulls, so branches for nulls are made with CASE.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.parts import dealt

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
ORDER_NOW, TASK_NOW = 883_612_800, 1_705_320_000
CONFIRMED = "2024-01-15T00:00:00+00:00"


@dataclass(frozen=True)
class Dialect:
    epoch: str
    iso: str
    sha: str

    def sql(self, text: str) -> str:
        """EPOCH(x), ISO(x), SHA(x) in this dialect."""
        while m := re.search(r"\b(EPOCH|ISO|SHA)\(", text):
            at, depth = m.end(), 1
            while depth:
                depth += {"(": 1, ")": -1}.get(text[at], 0)
                at += 1
            text = text[: m.start()] + getattr(self, m[1].lower()).replace("X", text[m.end() : at - 1]) + text[at:]
        return text


SPARK = Dialect("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', X)", "date_format(timestampadd(SECOND, X, TIMESTAMP_NTZ'1970-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\")", "sha2(X, 256)")
DUCKDB = Dialect("CAST(floor(epoch(X)) AS BIGINT)", "strftime(make_timestamp(CAST((X) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00')", "sha256(X)")

_STAMPS = "'2024-01-01T00:00:00+00:00' AS created_at"
LENS = {
    "users": f"SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS username, s_name AS fullname, {_STAMPS}, '2024-01-15T00:00:00+00:00' AS last_synced_at FROM $supplier",
    "courses": f"""SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS shortname, c_name AS fullname, CAST(c_nationkey AS BIGINT) AS category, c_custkey % 7 <> 0 AS visible, c_acctbal AS progress,
        CAST(1700000000 + c_custkey AS BIGINT) AS startdate, CAST(NULL AS BIGINT) AS enddate,
        CASE c_custkey % 4 WHEN 0 THEN 'inprogress' WHEN 1 THEN 'past' WHEN 2 THEN 'future' END AS timeline_classification, {_STAMPS}, '2024-01-15T00:00:00+00:00' AS last_synced_at FROM $customer""",
    "sections": f"""SELECT CAST(c_custkey * 10 + k AS BIGINT) AS id, CAST(c_custkey AS BIGINT) AS course_id, CAST(k AS BIGINT) AS section_number, c_mktsegment AS name, '' AS summary, true AS visible, {_STAMPS},
        CASE WHEN (c_custkey + k) % 3 = 0 THEN '2024-01-16T00:00:00+00:00' ELSE '2024-01-15T00:00:00+00:00' END AS last_synced_at
        FROM $customer, (SELECT 1 AS k UNION ALL SELECT 2) ks WHERE c_custkey % 11 <> 0""",
    "modules": f"""SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 150 AS BIGINT) AS course_id, CAST((p_partkey % 150) * 10 + 1 AS BIGINT) AS section_id,
        CASE p_partkey % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'resource' ELSE 'page' END AS modname, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS name,
        CASE WHEN p_partkey % 15 = 0 THEN '' WHEN p_partkey % 3 = 0 AND p_partkey % 7 <> 0 THEN concat('https://example.edu/u/', CAST(p_partkey AS STRING)) END AS url, true AS visible, {_STAMPS},
        CASE WHEN p_partkey % 4 = 0 THEN '2024-01-14T00:00:00+00:00' WHEN p_partkey % 4 = 1 THEN '2024-01-15T00:00:00+00:00' ELSE '2024-01-16T00:00:00+00:00' END AS last_synced_at FROM $part""",
    "files": f"""SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey AS BIGINT) AS module_id, concat(p_name, '.pdf') AS filename, '/' AS filepath, CAST(p_size AS BIGINT) * 1048576 AS filesize, 'application/pdf' AS mimetype,
        concat('https://example.edu/f/', CAST(p_partkey AS STRING), '?token=t', CAST(p_partkey AS STRING), '&forcedownload=1') AS fileurl, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(1700000000 + p_partkey AS BIGINT) END AS timemodified, {_STAMPS},
        CASE WHEN p_partkey % 5 = 0 THEN '2024-01-14T00:00:00+00:00' ELSE '2024-01-16T00:00:00+00:00' END AS last_synced_at FROM $part WHERE p_partkey % 3 = 1""",
    "assignments": f"""SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS course_id, concat('Task ', CAST(o_orderkey AS STRING)) AS name,
        CASE o_orderkey % 10 WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN NULL ELSE EPOCH(o_orderdate) + CAST(o_orderkey % 24 AS BIGINT) * 3600 END AS duedate,
        EPOCH(o_orderdate) - 86400 AS allowsubmissionsfromdate, CAST(NULL AS BIGINT) AS cutoffdate, o_totalprice AS grade, {_STAMPS},
        CASE WHEN o_orderkey % 6 = 0 THEN '2024-01-14T00:00:00+00:00' ELSE '2024-01-16T00:00:00+00:00' END AS last_synced_at FROM $orders""",
    "submissions": f"""SELECT CAST(o_orderkey AS BIGINT) AS assignment_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'submitted' WHEN o_orderstatus = 'O' THEN 'new' ELSE 'draft' END AS submission_status,
        'notgraded' AS grading_status, o_orderkey % 2 = 0 AS cansubmit, EPOCH(o_orderdate) AS submitted_at, {_STAMPS}, '2024-01-16T00:00:00+00:00' AS last_synced_at FROM $orders WHERE o_orderkey % 5 <> 0""",
    "grades": f"""SELECT CAST((l_orderkey * 8 + l_linenumber) * 64 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS course_id, CAST(1 AS BIGINT) AS user_id,
        CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_partkey AS BIGINT) END AS cmid, CASE WHEN l_linenumber = 2 THEN NULL ELSE concat('Item ', CAST(l_partkey AS STRING)) END AS item_name, CASE WHEN l_linenumber = 1 THEN 'course' ELSE 'mod' END AS item_type,
        l_returnflag AS item_module, l_quantity AS grade_raw, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS grade_formatted, l_linestatus AS percentage_formatted, {_STAMPS}, '2024-01-16T00:00:00+00:00' AS last_synced_at
        FROM $lineitem JOIN $orders ON l_orderkey = o_orderkey""",
    "calendar": f"""SELECT CAST(event_id AS BIGINT) AS id, CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(user_id AS BIGINT) END AS course_id, event_type AS name, concat('<p>', event_type, '</p> ') AS description, event_type AS eventtype,
        CAST(NULL AS STRING) AS modulename, CAST(NULL AS BIGINT) AS instance, EPOCH(ts) AS timestart, EPOCH(ts) AS timesort, CAST(0 AS BIGINT) AS timeduration, {_STAMPS}, '2024-01-16T00:00:00+00:00' AS last_synced_at FROM $events""",
    "resources": f"""SELECT CAST(p_partkey AS BIGINT) AS id, 'moodle' AS origin, CASE WHEN p_partkey % 3 = 0 THEN 'url' ELSE 'file' END AS source_type,
        CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS STRING) ELSE concat('https://example.edu/f/', CAST(p_partkey AS STRING), '?token=t', CAST(p_partkey AS STRING), '&forcedownload=1') END AS external_reference,
        CAST(p_partkey % 150 AS BIGINT) AS course_id, CAST((p_partkey % 150) * 10 + 1 AS BIGINT) AS section_id, CAST(p_partkey AS BIGINT) AS module_id, p_name AS name, concat('https://example.edu/u/', CAST(p_partkey AS STRING)) AS source_url, {_STAMPS},
        CASE WHEN p_partkey % 2 = 0 THEN '2024-01-16T00:00:00+00:00' ELSE '2024-01-15T00:00:00+00:00' END AS last_synced_at FROM $part WHERE p_partkey % 9 <> 0""",
    "raw_versions": """SELECT l_partkey, l_linenumber, l_returnflag, l_quantity, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS BIGINT) AS version_number
        FROM $lineitem WHERE l_partkey % 8 <> 0 AND l_partkey % 9 <> 0""",
    "versions": """SELECT CAST(l_partkey AS BIGINT) * 1000 + version_number AS id, CAST(l_partkey AS BIGINT) AS resource_id, version_number,
        CASE WHEN l_partkey % 2 = 0 THEN SHA(concat('https://example.edu/u/', CAST(l_partkey AS STRING))) ELSE SHA(concat(CAST(l_partkey AS STRING), '|', CAST(version_number AS STRING))) END AS content_hash, 'ref' AS storage_ref,
        CAST(l_quantity AS BIGINT) * 1048577 AS size_bytes, CASE WHEN l_linenumber = 3 THEN NULL ELSE 'application/pdf' END AS mimetype, '2024-01-10T00:00:00+00:00' AS ingested_at FROM $raw_versions""",
    "extractions": """SELECT (CAST(l_partkey AS BIGINT) * 1000 + version_number) * 10 + k AS id, CAST(l_partkey AS BIGINT) * 1000 + version_number AS resource_version_id, CASE WHEN (l_partkey + version_number + k) % 17 = 0 THEN 'deep' ELSE 'basic' END AS depth,
        CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'unsupported' WHEN l_linenumber = 5 THEN 'docx' ELSE 'pdf_hybrid' END AS extractor_name, '1' AS extractor_version,
        CASE WHEN l_returnflag = 'N' AND k = l_linenumber % 4 THEN 'done' ELSE 'failed' END AS status,
        CASE WHEN l_returnflag = 'N' AND k = l_linenumber % 4 THEN NULL WHEN (l_partkey + k) % 5 = 0 THEN NULL ELSE concat('E', CAST((l_partkey + k) % 7 AS STRING)) END AS error_reason, CAST('text' AS STRING) AS extracted_text,
        CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber % 2 = 0 THEN '{"method": "ocr"}' ELSE '{"method": "native", "pages": 3}' END AS metadata,
        concat('2024-01-1', CAST(k AS STRING), 'T00:00:00+00:00') AS extracted_at FROM $raw_versions, (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) ks WHERE k <= l_linenumber % 4""",
    "checks": "SELECT id AS resource_id, CASE WHEN id % 6 = 0 THEN NULL ELSE 1700000000 + id + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END END AS source_timemodified, '2024-01-10T00:00:00+00:00' AS checked_at FROM $resources WHERE id % 5 <> 0",
    "deferrals": """SELECT id AS resource_id, 'too_large' AS reason, CASE WHEN id % 3 = 0 THEN NULL ELSE 70000000 + id * 1000 END AS size_bytes, CAST(67108864 AS BIGINT) AS limit_bytes,
        CASE WHEN id % 16 = 0 THEN 1700000000 + id WHEN id % 7 = 0 THEN NULL ELSE CAST(1 AS BIGINT) END AS source_timemodified, '2024-01-10T00:00:00+00:00' AS deferred_at FROM $resources WHERE id % 8 = 0""",
    "executions": """SELECT CAST(event_id AS BIGINT) AS id, event_type AS job_name, CASE WHEN event_id % 3 = 0 THEN 'manual' ELSE 'interval' END AS trigger, CAST(1 + event_id % 3 AS BIGINT) AS attempt,
        CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 997 = 1 THEN 'running' ELSE 'done' END AS status, ISO(seconds_) AS started_at,
        CASE WHEN event_id % 997 = 1 AND event_id % 5 <> 0 THEN NULL ELSE ISO(seconds_ + 60) END AS finished_at, value AS duration_seconds, CAST(event_id % 50 AS BIGINT) AS items_processed, CAST(NULL AS STRING) AS detail,
        CASE WHEN event_id % 5 = 0 THEN concat('URLError: wstoken=secret', CAST(event_id AS STRING), '&x=1') END AS error FROM (SELECT *, EPOCH(ts) AS seconds_ FROM $events) e""",
    "requests": "SELECT CAST(event_id AS BIGINT) AS id, CASE WHEN event_id % 100 = 0 THEN 'nothing' ELSE event_type END AS job_name, ISO(seconds_ + 86400) AS requested_at FROM (SELECT *, EPOCH(ts) AS seconds_ FROM $events) e WHERE event_id % 50 = 0",
    "tasks": f"""SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id % 2000 AS BIGINT) AS course_id, CASE WHEN event_id % 10 = 0 THEN concat('Brace {{course}} ', CAST(event_id AS STRING)) ELSE concat('Task ', CAST(event_id AS STRING)) END AS name, EPOCH(ts) AS duedate,
        CAST(NULL AS BIGINT) AS allowsubmissionsfromdate, CAST(NULL AS BIGINT) AS cutoffdate, value AS grade, {_STAMPS}, CASE WHEN event_id % 6 = 0 THEN '2024-01-14T00:00:00+00:00' ELSE '2024-01-16T00:00:00+00:00' END AS last_synced_at FROM $events""",
    "task_status": "SELECT CAST(event_id AS BIGINT) AS assignment_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'submitted' ELSE 'new' END AS submission_status, 'notgraded' AS grading_status FROM $events WHERE event_id % 5 <> 0",
    "sent": "SELECT CAST(event_id AS BIGINT) AS id, CASE WHEN event_id % 2 = 0 THEN 'assignment_due_24h' ELSE 'assignment_due_12h' END AS notification_type, concat('assignment:', CAST(event_id AS STRING)) AS subject_key, ISO(seconds_) AS scheduled_for, '2024-01-15T00:00:00+00:00' AS sent_at FROM (SELECT *, EPOCH(ts) AS seconds_ FROM $events) e WHERE event_id % 3 = 0",
    "rule_sets": """SELECT CAST(l_suppkey AS BIGINT) AS set_id, concat('q', CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS id, CAST(l_quantity AS BIGINT) * 5400 + CAST(l_suppkey AS BIGINT) * 7 AS offset_seconds, min(l_linenumber) <= 3 AS enabled,
        '{assignment}' AS title_template, '{remaining}' AS body_template, '2024-01-10T00:00:00+00:00' AS updated_at FROM $lineitem GROUP BY l_suppkey, l_quantity""",
    "rule_drafts": """SELECT CAST(o_custkey AS BIGINT) AS set_id, o_orderpriority AS id, (CAST(floor(o_totalprice) AS BIGINT) % 40 - 2) * 1800 AS offset_seconds, '{assignment}' AS title_template, '{remaining}' AS body_template FROM $orders""",
    "rule_marks": "SELECT CAST(s_suppkey AS BIGINT) AS set_id FROM $supplier WHERE s_acctbal > 2000",
}
#: Logical tables that are joined or numbered over whole source tables: these are dealt out to them by the keys that they meet by.
DEALT = {"grades": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}
#: Up to so many orders of a course, their keys are sent to where the lines lie.
FEW = 1 << 14


def _used(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\$(\w+)", text)))


class Lens:
    """Tables by name for Spark."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._prefix = f"lens_{zlib.crc32(sf_dir.encode()):08x}_"
        self._made: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in SOURCES else self.sql(LENS[name], DEALT.get(name, {}))
        return self._made[name]

    def rows(self, name: str) -> int:
        """How many rows a source table has, from the footers of its files."""
        if name not in self._rows:
            self._rows[name] = self[name].count()
        return self._rows[name]

    def grades_of(self, course: int) -> DataFrame:
        """A table with all grades of a course, and numbered as in the whole one: it takes all lines and orders of the keys of the course's orders. No other line is
        sorted, as numbers are given within an order. Where the course has very many orders, it is the whole table, in parts."""
        keys = self["orders"].filter(F.col("o_custkey").cast("long") == course).select(F.col("o_orderkey").alias("_key"))
        if keys.count() > FEW:
            return self["grades"]
        only = {name: self[name].join(F.broadcast(keys), F.col(key) == F.col("_key"), "left_semi") for name, key in DEALT["grades"].items()}
        return self.sql(LENS["grades"], only=only)

    def sql(self, text: str, by: Mapping[str, str] | None = None, only: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """A query in Spark's dialect over these tables, some of them dealt out by a column, or others in the place of some."""
        by, only = by or {}, only or {}
        most = max((self.rows(other) for other in by), default=0)
        for other in _used(text):
            (only[other] if other in only else dealt(self[other], most, by[other]) if other in by else self[other]).createOrReplaceTempView(self._prefix + other)
        return self.spark.sql(re.sub(r"\$(\w+)", lambda m: self._prefix + m[1], SPARK.sql(text)))


def duckdb_sql(text: str) -> str:
    """A query over $tables as one statement for DuckDB: the logical tables that it uses are put before it."""
    order: list[str] = []

    def visit(t: str) -> None:
        for name in _used(t):
            if name in LENS and name not in order:
                visit(LENS[name])
                order.append(name)

    visit(text)
    plain = lambda t: DUCKDB.sql(re.sub(r"\$(\w+)", r"\1", t))
    body = plain(text).strip()
    parts = [f"{name} AS ({plain(LENS[name])})" for name in order]
    if parts and body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}" if parts else body

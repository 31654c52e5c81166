"""The warehouse's log of parts: against a dictionary, across merges and vacuums, and by the bytes that it writes."""

import random

import pytest
from pyspark.sql import functions as F

from quadrivo.control.ledger import Result, WarehouseLedger
from quadrivo.operators import state
from quadrivo.sources import commit_log, schema
from quadrivo.sources.commit_log import FAN, Log, Part, due
from quadrivo.sources.warehouse import Warehouse


def deferral(spark, rows):
    return spark.createDataFrame([(k, "too_large", v, 1, None, "t") for k, v in rows], schema.schema("deferrals"))


def held(w):
    rows = [(r.resource_id, r.size_bytes) for r in w["deferrals"].collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_log_as_text():
    log = Log({"courses": (Part("courses/a"), Part("courses/b", True, 4, 99)), "users": ()}, {"files": 7}, {"courses/x": 123})
    assert Log.parsed(log.text()) == Log({"courses": log.parts["courses"]}, log.last_ids, log.gone)
    assert Log.parsed("") == Log()


def appended(n, size):
    """Bytes written by n commits of so many bytes, merges included, and the parts at the end."""
    parts, total = [], 0
    for _ in range(n):
        parts.append(Part("p", size=size))
        total += size
        while (start := due(parts)) is not None:
            made = sum(p.size for p in parts[start:])
            parts[start:] = [Part("p", size=made)]
            total += made
    return total, parts


def test_bytes_grow_with_the_rows():
    for size in (100, 5000):
        small, _ = appended(1000, size)
        large, parts = appended(16_000, size)
        assert small <= 10 * 1000 * size
        assert large / small < 16 * 2  # not 256 times as much
        assert len(parts) <= 8 * FAN
    assert due([Part("p", size=100)] * (FAN - 1)) is None and due([Part("p", size=1 << 30), *[Part("p", size=1)] * FAN]) == 1


def test_against_a_dictionary(spark, tmp_path):
    """Rows added, put over others, ended and put again, through merges of some parts and of all."""
    rng, w, want = random.Random(5), Warehouse(spark, f"file://{tmp_path}/w"), {}
    for step in range(30):
        fresh = {rng.randrange(1000, 10**6): step for _ in range(2)}
        some = {k: -step for k in rng.sample(sorted(want), min(len(want), 2))}
        ended = rng.sample(sorted(want), min(len(want), 2))
        kind = rng.choice(["append", "put", "drop", "all", "tables"] if step % 7 == 6 else ["append", "put", "drop", "all"])
        if kind == "append":
            w.commit(append={"deferrals": deferral(spark, fresh.items())})
            want |= fresh
        elif kind == "put":
            w.commit(put={"deferrals": deferral(spark, (fresh | some).items())})
            want |= fresh | some
        elif kind == "drop":
            w.commit(drop={"deferrals": spark.createDataFrame([(k,) for k in [*ended, 7]], "resource_id long")})
            want = {k: v for k, v in want.items() if k not in ended}
        elif kind == "all":
            w.commit(append={"checks": spark.createDataFrame([(step, None, "t")], schema.schema("checks"))}, drop={"deferrals": spark.createDataFrame([(k,) for k in ended], "resource_id long")}, put={"deferrals": deferral(spark, some.items())})
            want = {k: v for k, v in want.items() if k not in ended} | some
        else:
            want = dict(fresh)
            w.commit({"deferrals": deferral(spark, want.items())})
        if step % 3 == 0:
            assert held(w) == want
            keys = [*rng.sample(sorted(want), min(len(want), 3)), 5]
            found = w.find("deferrals", spark.createDataFrame([(k,) for k in keys], "resource_id long"))
            assert {r.resource_id: r.size_bytes for r in found.collect()} == {k: want[k] for k in keys if k in want}
    assert len(w.log().parts["deferrals"]) < 3 * FAN
    w.merge("deferrals", whole=True)
    assert len(w.log().parts["deferrals"]) == 1 and not w.log().parts["deferrals"][0].over and held(w) == want


def test_a_reader_sees_one_state(spark, tmp_path):
    """A table that was opened is read as it was, across commits, a merge and a vacuum within the grace time; after that its folders are gone."""
    clock = [1000.0]
    w = Warehouse(spark, f"file://{tmp_path}/w", now=lambda: clock[0])
    for i in range(3):
        w.commit(append={"deferrals": deferral(spark, [(i, i)])})
    opened = w["deferrals"]
    w.commit(put={"deferrals": deferral(spark, [(0, 99)])})
    assert w.merge("deferrals", whole=True) and not w.merge("deferrals", whole=True)
    assert w.vacuum(3600) == []
    assert sorted((r.resource_id, r.size_bytes) for r in opened.collect()) == [(0, 0), (1, 1), (2, 2)] and held(w) == {0: 99, 1: 1, 2: 2}
    clock[0] += 3601
    before = w.size()
    assert len(w.vacuum(3600)) == 4 and w.size() < before
    assert held(w) == {0: 99, 1: 1, 2: 2} and w.vacuum(3600) == [] and not w.log().gone


def test_a_broken_commit_changes_nothing(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    w.commit(append={"deferrals": deferral(spark, [(1, 1)])})
    broken = deferral(spark, [(2, 2)]).withColumn("size_bytes", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        w.commit(append={"checks": spark.createDataFrame([(1, None, "t")], schema.schema("checks")), "deferrals": broken})
    assert held(w) == {1: 1} and w["checks"].count() == 0
    later = Warehouse(spark, w.root, now=lambda: w.now() + 10_000)
    assert len(later.vacuum(3600)) == 2 and held(w) == {1: 1}  # what it left behind


def test_attempts_are_small_commits(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    ledger, written = WarehouseLedger(w), []
    for i in range(20):
        entry = ledger.begin("sync", "manual", 1, f"2024-01-{i:02}")
        assert entry == i + 1
        if i != 13:
            ledger.end(entry, "done", f"2024-01-{i:02}", 1.0, Result(i))
        written.append(w.size())
    rows = {r.id: (r.status, r.items_processed, r.started_at) for r in w["executions"].collect()}
    assert rows == {i + 1: ("running" if i == 13 else "done", None if i == 13 else i, f"2024-01-{i:02}") for i in range(20)}
    assert written[-1] - written[9] < 1.6 * (written[9] - written[0]) * 10 / 9  # as much for the second ten as for the first
    assert ledger.last_status("sync") == "done" and ledger.fail_open("later") == 1 and ledger.fail_open("later") == 0
    assert len(w.log().parts["executions"]) < 2 * FAN and w["executions"].count() == 20


def test_ids_are_never_given_twice(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    w.commit({"versions": spark.createDataFrame([(41, 1, 1, "h", "r", 1, None, "t")], schema.schema("versions"))})
    assert w.reserve("versions", 0) == 41 and w.reserve("versions", 5) == 41 and w.reserve("versions", 2) == 46
    w.commit({"versions": w["versions"].limit(0)})
    assert w.reserve("versions", 1) == 48 and w.reserve("files", 3) == 0


def test_a_small_upsert_into_a_large_table(spark, tmp_path, monkeypatch):
    """25 rows over a million: no bucket is written again, and 25 of them at most are read."""
    monkeypatch.setattr(commit_log, "BUCKET_BYTES", 1 << 16)
    w = Warehouse(spark, f"file://{tmp_path}/w")
    rows = spark.range(1_000_000).selectExpr("id", "id % 100 AS course_id", "concat('name ', id) AS name", "id AS duedate", "CAST(NULL AS LONG) AS allowsubmissionsfromdate", "CAST(NULL AS LONG) AS cutoffdate", "1D AS grade", "'c' AS created_at", "'s' AS last_synced_at")
    w.commit({"assignments": rows})
    (part,) = w.log().parts["assignments"]
    assert part.buckets >= 64
    batch = spark.createDataFrame([(40_000 * i + (10**6 if i % 5 == 0 else 0), 1, f"new {i}", i, i) for i in range(25)], "id long, course_id long, name string, duedate long, _seq long")
    found = w.find("assignments", batch)
    read = {f for r in found.select(F.input_file_name().alias("f")).distinct().collect() for f in [r.f]}
    scanned = len(found.inputFiles())
    assert len(read) <= 25 and scanned >= part.buckets
    assert "PartitionFilters: [_bucket" in found._jdf.queryExecution().toString()
    w.commit(put={"assignments": state.upsert(found, batch, ["id"], "now")})
    kept, more = w.log().parts["assignments"]
    assert kept == part and more.size < part.size / 500
    assert w["assignments"].count() == 1_000_005
    changed = {r.id: (r.name, r.created_at, r.last_synced_at) for r in w["assignments"].filter("last_synced_at = 'now'").collect()}
    assert changed == {40_000 * i + (10**6 if i % 5 == 0 else 0): (f"new {i}", "now" if i % 5 == 0 else "c", "now") for i in range(25)}


def test_commits_of_two_threads(spark, tmp_path):
    """A streaming query and a job commit side by side: nothing that one adds is lost to the other, merges included."""
    from concurrent.futures import ThreadPoolExecutor

    def work(start):
        w = Warehouse(spark, f"file://{tmp_path}/w")
        for i in range(start, start + 12):
            last = w.reserve("files", 1)
            w.commit(append={"deferrals": deferral(spark, [(i, last)])})

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(work, [0, 100]))
    got = held(Warehouse(spark, f"file://{tmp_path}/w"))
    assert sorted(got) == [*range(12), *range(100, 112)] and sorted(got.values()) == list(range(24))

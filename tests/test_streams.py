"""The change feed and the outbox: restarts, lost tasks, and what they record."""

import json
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quadrivo.operators.history import OVERLAP_SECONDS, asked_since
from quadrivo.sources import changes, outbox, platform
from quadrivo.sources.warehouse import Warehouse
from quadrivo.streaming import changes as stream
from tests.test_sources import FolderSink


@pytest.fixture
def site():
    """A platform of two courses, that keeps what it was asked; changed: the time of each course's last change."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            form = dict(urllib.parse.parse_qsl(self.rfile.read(int(self.headers["Content-Length"])).decode()))
            made = self.server
            name, course = form["wsfunction"], int(form.get("courseid", 0))
            made.asked.append((name, course, int(form.get("since", -1))))
            if name == platform.FUNCTIONS["site_info"]:
                said = {"userid": 7}
            elif name == platform.FUNCTIONS["courses"]:
                said = [{"id": 1}, {"id": 2}]
            elif name == platform.FUNCTIONS["updates"]:
                said = {"instances": [{"id": 1}] if made.changed[course] >= int(form["since"]) else [], "warnings": []}
            else:
                files = [{"type": "file", "filename": f"f{i}", "fileurl": f"https://h/{course}/{i}", "timemodified": made.stamp} for i in range(made.files[course])]
                said = [{"id": 10 * course, "section": 0, "modules": [{"id": 100 * course, "modname": "resource", "name": f"R{made.stamp}", "contents": files}]}]
            body = json.dumps(said).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    server.asked, server.changed, server.files, server.stamp = [], {1: 0, 2: 0}, {1: 2, 2: 1}, 1
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def run(spark, site, w, where, fetch=None):
    base = f"http://127.0.0.1:{site.server_port}"
    site.asked.clear()
    fetch = fetch or (lambda function, params: platform.calls(spark, base, "t", function, params))
    query = stream.start(changes.feed(spark, base, "t"), w, fetch, where)
    query.awaitTermination(120)
    return site.asked


def contents(w):
    return {r.id: r.name for r in w["modules"].collect()}, sorted((r.id, r.fileurl) for r in w["files"].collect()), w["sections"].count()


def test_a_restart_neither_loses_nor_doubles(spark, tmp_path, site):
    w, where = Warehouse(spark, f"file://{tmp_path}/w"), f"file://{tmp_path}/checkpoint"
    began = int(time.time())
    asked = run(spark, site, w, where)
    assert {c for n, c, _ in asked if n == platform.FUNCTIONS["contents"]} == {1, 2} and not any(n == platform.FUNCTIONS["updates"] for n, *_ in asked)
    first = contents(w)
    assert first[0] == {100: "R1", 200: "R1"} and len(first[1]) == 3 and first[2] == 2

    # Nothing changed: only the question is asked, from a little before where the first batch ended.
    time.sleep(1.1)
    asked = run(spark, site, w, where)
    since = [s for n, _, s in asked if n == platform.FUNCTIONS["updates"]]
    assert len(since) == 2 and all(began - OVERLAP_SECONDS <= s <= int(time.time()) - OVERLAP_SECONDS for s in since)
    assert not any(n == platform.FUNCTIONS["contents"] for n, *_ in asked) and contents(w) == first

    # A batch that breaks is done again from the same offset, and nothing that was told meanwhile is lost.
    site.stamp, site.files[1] = 2, 3
    site.changed[1] = int(time.time())
    time.sleep(1.1)

    def broken(function, params):
        raise OSError("no route")

    with pytest.raises(Exception, match="no route"):
        run(spark, site, w, where, broken)
    assert contents(w) == first
    time.sleep(1.1)
    asked = run(spark, site, w, where)
    assert {c for n, c, _ in asked if n == platform.FUNCTIONS["contents"]} == {1}
    second = contents(w)
    assert second[0] == {100: "R2", 200: "R1"} and len(second[1]) == 4 and second[1][:3] == first[1] and second[2] == 2


def test_a_batch_done_twice_changes_nothing(spark, tmp_path, site):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    base = f"http://127.0.0.1:{site.server_port}"
    told = spark.createDataFrame([(1, 5, 9, 1, 0), (2, 5, 9, 0, 0)], "course_id long, since long, until long, n_instances long, n_warnings long")
    fetch = lambda function, params: platform.calls(spark, base, "t", function, params)
    assert stream.apply(w, told, fetch, "t1") == 1
    first = contents(w)
    assert stream.apply(w, told, fetch, "t2") == 1 and contents(w) == first
    assert stream.apply(w, told.filter("course_id = 2"), fetch, "t3") == 0


def test_offsets_and_the_job_ask_from_the_same_time(spark):
    assert asked_since(1000) == 700 and asked_since(10) == 0
    assert [r.s for r in spark.createDataFrame([(1000,), (10,)], "x long").select(asked_since(F.col("x")).alias("s")).collect()] == [700, 0]


ROWS = "notification_type string, subject_key string, scheduled_for string, title string, body string"


def rows(n, start=0):
    return [Row(notification_type="k", subject_key=f"s{i}", scheduled_for="t", title=f"m{i}", body="b") for i in range(start, start + n)]


def test_a_lost_task_sends_its_own_rows_again_at_most(spark, tmp_path):
    """Two tasks; the first one is lost after three messages, and tried again. The receipts are those of the attempts that ended."""
    sink = FolderSink(str(tmp_path / "sent"))
    writer = outbox.Outbox(sink, f"file://{tmp_path}/receipts")

    def lost():
        yield from rows(3)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(lost())
    done = [writer.write(iter(rows(5, 5))), writer.write(iter(rows(5)))]
    writer.commit(done)
    assert sink.titles() == sorted([f"m{i}" for i in range(10)] + ["m0", "m1", "m2"])
    told = outbox.receipts(spark.createDataFrame([], ROWS), f"file://{tmp_path}/receipts")
    assert sorted(r.subject_key for r in told.collect()) == [f"s{i}" for i in range(10)]


def test_tasks_send_and_say_what_they_sent(spark, tmp_path):
    sink = FolderSink(str(tmp_path / "sent"), ["m3"])
    messages = spark.createDataFrame(rows(8), ROWS).repartition(3)
    told = outbox.send(messages, sink, f"file://{tmp_path}/receipts").collect()
    assert len(told) == 8 and [(r.subject_key, r.error) for r in told if r.error] == [("s3", "RuntimeError: down")]
    assert sink.titles() == sorted(f"m{i}" for i in range(8) if i != 3)
    assert outbox.receipts(messages, f"file://{tmp_path}/none").count() == 0
    plan = messages._jdf.queryExecution().toString()
    assert "FolderSink" not in plan


def test_what_was_sent_before_a_cycle_broke_is_recorded(spark, tmp_path):
    writer = outbox.Outbox(FolderSink(str(tmp_path / "sent")), f"file://{tmp_path}/receipts")
    writer.abort([writer.write(iter(rows(2))), None])
    assert outbox.receipts(spark.createDataFrame([], ROWS), f"file://{tmp_path}/receipts").count() == 2

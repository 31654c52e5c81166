import io
import json
import os
import urllib.error
import uuid

import pytest

from quadrivo.operators.reminders import Rule
from quadrivo.sources import platform, sinks, warehouse
from quadrivo.sources.warehouse import Warehouse


class FolderSink:
    """Leaves a file for each message, as messages are sent by the executors."""

    def __init__(self, where, broken=()):
        self.where, self.broken = where, list(broken)

    def send(self, m):
        if m.title in self.broken:
            raise RuntimeError("down")
        os.makedirs(self.where, exist_ok=True)
        with open(f"{self.where}/{uuid.uuid4().hex}", "w") as f:
            f.write(m.title)

    def titles(self):
        found = []
        for name in os.listdir(self.where) if os.path.exists(self.where) else ():
            with open(f"{self.where}/{name}") as f:
                found.append(f.read())
        return sorted(found)


class Reply(io.BytesIO):
    def __init__(self, body, headers=None):
        super().__init__(body)
        self.headers = headers or {}


def opener(*replies):
    left, asked = list(replies), []

    def open_(request, timeout=None):
        asked.append(request)
        r = left.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    open_.asked = asked
    return open_


def test_flatten():
    assert platform.flatten({"options": [{"name": "x", "value": 1}], "on": True, "none": None, "n": {"a": (1, 2)}}) == {"options[0][name]": "x", "options[0][value]": "1", "on": "1", "none": "", "n[a][0]": "1", "n[a][1]": "2"}
    assert platform.flatten({}) == {}


def test_calls_are_retried_and_errors_told():
    slept = []
    busy = urllib.error.HTTPError("u", 503, "busy", {}, io.BytesIO())
    c = platform.Client("https://h.edu", "t", open=opener(busy, urllib.error.URLError("x"), Reply(b'{"userid": 5}')), sleep=slept.append)
    assert c.user_id() == 5 == c.user_id() and slept == [1, 2]
    with pytest.raises(urllib.error.HTTPError):
        platform.Client("https://h.edu", "t", open=opener(urllib.error.HTTPError("u", 404, "no", {}, io.BytesIO()))).call("f")
    for code, auth in (("invalidtoken", True), ("x", False)):
        with pytest.raises(platform.ApiError) as e:
            platform.Client("https://h.edu", "t", open=opener(Reply(json.dumps({"exception": "e", "errorcode": code}).encode()))).call("f")
        assert e.value.auth is auth


def test_downloads():
    def client(*replies, most=10):
        return platform.Client("https://h.edu", "tok", most_bytes=most, open=opener(*replies))

    c = client(Reply(b"body", {"Content-Length": "4"}))
    assert c.download("https://h.edu/f?token=old&x=1") == b"body" and c.open.asked == ["https://h.edu/f?x=1&token=tok"]
    for url in ("https://evil.org/f", "http://h.edu/f", "https://a.h.edu/f"):
        with pytest.raises(PermissionError):
            client().download(url)
    for reply in (Reply(b"", {"Content-Length": "11"}), Reply(b"x" * 11)):
        with pytest.raises(platform.TooLarge):
            client(reply).download("https://h.edu/f")
    for reply in (Reply(b""), Reply(b"xy", {"Content-Length": "3"})):
        with pytest.raises(ConnectionError):
            client(reply).download("https://h.edu/f")
    error = json.dumps({"exception": "e", "errorcode": "c"}).encode()
    with pytest.raises(platform.ApiError):
        client(Reply(error, {"Content-Type": "application/json"}), most=99).download("https://h.edu/f")


def test_source_and_fixtures(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"params": {"courseid": 1}, "payload": [{"id": 10}]}\n')
    r = platform.fixtures(spark, str(tmp_path / "f.jsonl")).first()
    assert json.loads(r.payload) == [{"id": 10}] and json.loads(r.params) == {"courseid": 1}
    reader = platform.PlatformSource({"base": "https://h", "token": "t", "function": "f", "calls": '[{"a": 1}, {"a": 2}]'}).reader(None)
    assert [p.params for p in reader.partitions()] == ['{"a": 1}', '{"a": 2}']
    df = platform.downloads(spark.createDataFrame([("https://evil.org/f",)], "fileurl string"), "https://h.edu", "t")
    assert df.first().outcome == "failed"


def test_sinks(caplog):
    m = sinks.Message("assignment_due_1h", "t", "b" * 5000)
    assert len(m.text()) == 4096 and m.text().endswith("…")
    ok = opener(Reply(b'{"ok": true}'))
    sinks.ChatSink("1:x", "c", open=ok).send(m)
    assert ok.asked[0].full_url.endswith("/bot1:x/sendMessage")
    for reply, said in ((Reply(b'{"ok": false, "description": "chat not found"}'), "chat not found"), (Reply(b"no"), "not JSON"), (urllib.error.HTTPError("u", 401, "x", {}, io.BytesIO(b'{"description": "Unauthorized"}')), "HTTP 401: Unauthorized")):
        with pytest.raises(sinks.NotDelivered, match=said):
            sinks.ChatSink("1:x", "c", open=opener(reply)).send(m)
    assert isinstance(sinks.choose(env={}), sinks.LogSink) and isinstance(sinks.choose(env={"TELEGRAM_BOT_TOKEN": "a", "TELEGRAM_CHAT_ID": "b"}), sinks.ChatSink)
    import logging

    log, out = logging.Logger("apart"), io.StringIO()
    log.addHandler(logging.StreamHandler(out))
    log.handlers[0].setFormatter(logging.Formatter("%(levelname)s %(message)s"))
    sinks.guard(log)
    sinks.guard(log)
    try:
        raise ValueError("token=abc")
    except ValueError:
        log.exception("at %s", "wstoken=secret&x", stack_info=True)
    said = out.getvalue()
    assert said.startswith("ERROR at wstoken=***&x") and "Traceback" in said and "Stack" in said and "secret" not in said.split("Stack")[0] and "token=abc" not in said.split("Stack")[0]


def test_warehouse(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    assert w["courses"].count() == 0
    row = spark.createDataFrame([(1, 5)], "id long, course_id long")
    full = w["sections"].select().limit(0)
    from quadrivo.sources import schema

    rows = spark.createDataFrame([(1, 5, 1, "n", "", True, "c", "s")], schema.schema("sections"))
    w.commit({"sections": rows})
    w.commit({"sections": w["sections"].unionByName(rows)})
    assert w["sections"].count() == 2 and row.count() == 1 and full.columns == []
    counts = {r.table_name: r.n for r in w.purge("1").collect()}
    assert counts["sections"] == 2 and len(counts) == 14 and w["sections"].count() == 0
    assert spark.read.parquet(f"file://{tmp_path}/w/backups/before-purge-1/sections").count() == 2
    for stamp in ("2", "3"):
        w.backup(stamp)
    assert w.keep_newest_backups(1) == ["before-purge-1", "2"]
    with pytest.raises(KeyError):
        w["nothing"]


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/objects"
    objects = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),), (None,)], "content binary")
    first = sorted(map(tuple, warehouse.store(objects, root).collect()))
    assert len(first) == 2 and sorted(map(tuple, warehouse.store(objects, root).collect())) == first
    assert tuple(warehouse.storage_totals(spark, root).first()) == (2, 2)
    hashes = spark.createDataFrame([(first[0][0],), ("no",)], "content_hash string")
    assert warehouse.retrieve(spark, root, hashes).count() == 1
    assert warehouse.valid_ref(first[0][1]) and not warehouse.valid_ref("../etc/passwd") and not warehouse.valid_ref("aa/" + "b" * 64)


def test_point_reads_open_little(spark, tmp_path):
    """25 of 10,000 objects: under a tenth of the bytes are read; a larger set is met by a dynamic partition filter."""
    from pyspark.sql import functions as F

    root = f"file://{tmp_path}/objects"
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    noise = F.encode(F.concat_ws("", *(F.sha2(F.concat(F.col("id"), F.lit(f"/{i}")), 512) for i in range(32))), "UTF-8")
    objects = spark.range(10_000).select("id", noise.alias("content"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    kept = warehouse.store(objects, root).drop("storage_ref")
    whole = spark._jvm.org.apache.hadoop.fs.Path(root)
    size = whole.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(whole).getLength()
    names = kept.orderBy("content_hash").collect()
    read = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    few = spark.createDataFrame([(r.content_hash,) for r in names[::400]], "content_hash string")
    assert few.count() == 25
    found = warehouse.retrieve(spark, root, few)
    before = read()
    assert found.agg(F.count("*"), F.sum(F.length("content"))).first()[0] == 25
    assert 0 < read() - before < size / 10
    many = spark.createDataFrame([(r.content_hash,) for r in names[::100]], "content_hash string")
    met = warehouse.retrieve(spark, root, many)
    assert "dynamicpruning" in met._jdf.queryExecution().executedPlan().toString() and met.count() == 100
    assert warehouse.retrieve(spark, root, few.limit(0)).count() == 0 == warehouse.retrieve(spark, f"{root}/none", few).count()


def test_reminder_stream(spark, tmp_path):
    from quadrivo.sources import schema
    from quadrivo.streaming import reminders as stream

    n, w = 1_705_320_000, Warehouse(spark, f"file://{tmp_path}/w")
    w.commit({
        "assignments": spark.createDataFrame([(i, 1, f"a{i}", n + 3000 * i, None, None, None, "c", "2024-02") for i in (1, 2, 9)], schema.schema("assignments")),
        "submissions": spark.createDataFrame([(i, "new", None, None, None, "c", "s") for i in (1, 2, 9)], schema.schema("submissions")),
        "courses": spark.createDataFrame([(1, "s", "Course", None, True, None, None, None, None, "c", "s")], schema.schema("courses")),
    })
    sink = FolderSink(str(tmp_path / "sent"), ["a2"])
    rules = [Rule("6h", 21600, "{assignment}", "x"), Rule("1h", 3600, "{assignment}", "y")]
    out = stream.send_cycle(w, rules, n, "2024-01", sink, "t0")
    assert out == {"pending": 2, "sent": 1, "failed": 1, "first_error": "RuntimeError: down"} and sink.titles() == ["a1"]
    sink.broken.clear()
    w.commit({"executions": spark.createDataFrame([(1, "moodle_sync", "t", 1, "done", "2024-01", None, None, None, None, None)], schema.schema("executions"))})
    ticks = spark.createDataFrame([(n - 5, "2024-01", "t1"), (n + 10_000, None, "t2")], "now long, confirmed string, at string")
    ticks.write.parquet(f"file://{tmp_path}/ticks")
    source = spark.readStream.schema(ticks.schema).parquet(f"file://{tmp_path}/ticks")
    for _ in range(2):  # a restart finds nothing new
        stream.start(source, w, lambda: rules, sink, f"file://{tmp_path}/checkpoint").awaitTermination(120)
    assert sink.titles() == ["a1", "a9"] and w["sent"].count() == 2


def test_systemic_errors():
    inner = platform.ApiError("invalidtoken", "", True)
    outer = RuntimeError("x")
    outer.__cause__ = inner
    assert platform.systemic(outer) and not platform.systemic(platform.ApiError("c", "", False)) and not platform.systemic(None)

import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import types as T

from quadrivo.llm.byte_bpe import byte_bpe
from quadrivo.llm.shared import new_path
from quadrivo.llm.sorted_table import ShardReader, ShardWriter, encode_key, look_up, read_sorted_table, write_sorted_table

PATH = P.path("byte_bpe_50k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.LongType())])


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_shard_round_trip_and_lookup():
    rng = random.Random(1)
    keys = sorted(rng.sample(range(-5000, 5000), 800)) + [6000] * 50
    rows = [(k, np.array([rng.randrange(50000) for _ in range(rng.randrange(40))], "<u2")) for k in keys]
    out = io.BytesIO()
    w = ShardWriter(out, 2, 512)
    w.add(encode_key(None), b"")
    for k, v in rows:
        w.add(encode_key(k), v.tobytes())
    w.close()
    r = ShardReader(Source(out.getvalue()))
    got = list(r.scan())
    assert [g[0] for g in got] == [None, *keys] and r.entries == len(keys) + 1
    assert [g[2].tolist() for g in got[1:]] == [v.tolist() for _, v in rows]
    assert [g[1] for g in got[1:]] == np.cumsum([0, *(len(v) for _, v in rows)])[:-1].tolist()
    for k in range(-5000, 6001, 37):
        assert [x.tolist() for x in r.get(k)] == [v.tolist() for q, v in rows if q == k]
    assert len(r.get(6000)) == 50 and len(r.get(None)) == 1
    assert sum(r.may_hold(k) for k in range(10_000, 20_000)) < 300
    assert len(out.getvalue()) < sum(len(v) * 2 + 9 for _, v in rows) + 15_000
    with pytest.raises(ValueError):
        w.add(encode_key(0), b"")


def test_attempts_that_were_killed_are_no_part_of_the_table(spark):
    """Files of other attempts lie beside those of the manifest, whole or cut, and a table can be written twice to one folder."""
    path = new_path(spark, "t")
    df = spark.createDataFrame([(i, f"text {i}", 0) for i in range(50)], SCHEMA)
    first = write_sorted_table(df, PATH, path)
    folder = path.removeprefix("file://")
    for s in first:
        name = s["path"].rsplit("/", 1)[1]
        with open(f"{folder}/{name[:13]}{'0' * 32}.sst", "wb") as f:
            f.write(open(f"{folder}/{name}", "rb").read()[:100])
    again = write_sorted_table(df, PATH, path)
    assert {s["path"] for s in first}.isdisjoint(s["path"] for s in again)
    for manifest in (first, again):
        assert sorted(r.doc_id for r in read_sorted_table(spark, manifest).collect()) == list(range(50)) and len(look_up(manifest, 7)) == 1


def test_equal_rows_spread_over_shards(spark):
    df = spark.range(4000).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "id start")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are put together again
    try:
        manifest = write_sorted_table(df, PATH, new_path(spark, "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) > 1 and max(s["entries"] for s in manifest) < 2500 and sum(s["entries"] for s in manifest) == 4000
    assert len(look_up(manifest, None)) == 4000


def test_other_keys_are_refused(spark):
    with pytest.raises(TypeError):
        write_sorted_table(spark.createDataFrame([("a", "x")], "doc_id string, text string"), PATH, new_path(spark, "t"))


def test_table_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "x", "hello <|endoftext|> é", "word " * 30_000, *(" ".join(rng.choices(["a", "bc", "déf", "\n"], k=rng.randrange(60))) for _ in range(300))]
    rows = [(rng.randrange(-50, 400), t, 7) for t in texts] + [(5, "same", 0)] * 3 + [(None, "null key", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    manifest = write_sorted_table(df, PATH, new_path(spark, "t"))
    got = [tuple(r) for r in read_sorted_table(spark, manifest).collect()]
    got.sort(key=lambda r: r[1])
    keys = [r[0] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(got) == len(rows)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    bpe = byte_bpe(PATH)
    want = sorted((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, t, _ in rows if k is not None for ids in [[*bpe.hf.encode(t or "", add_special_tokens=False).ids, 0]])
    assert sorted((k, n, c) for k, _, n, c in got if k is not None) == want
    assert len(look_up(manifest, 5)) == sum(r[0] == 5 for r in rows)
    assert look_up(manifest, 9999) == []
    assert write_sorted_table(spark.createDataFrame([], SCHEMA), PATH, new_path(spark, "t")) == []
    assert read_sorted_table(spark, []).count() == 0


def test_look_up_opens_one_shard(spark, monkeypatch):
    from quadrivo.llm import sorted_table as st

    rows = [(i, f"text {i}") for i in range(0, 4000, 2)] + [(None, "none"), (None, "none too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = write_sorted_table(df, PATH, new_path(spark, "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) == 4 and manifest[0]["first"] is None and manifest[-1]["last"] == 3998
    assert all(a["last"] < b["first"] for a, b in zip(manifest[1:], manifest[2:]))
    opened, plain = [], st.open_path
    monkeypatch.setattr(st, "open_path", lambda path: opened.append(path) or plain(path))
    ends = [s[c] for s in manifest for c in ("first", "last") if s[c] is not None]
    for key in [0, 2, 1001, 2000, 3998, *ends]:
        opened.clear()
        assert [len(x) > 1 for x in look_up(manifest, key)] == [True] * (key % 2 == 0)
        assert len(opened) <= 1
    opened.clear()
    assert len(look_up(manifest, None)) == 2 and len(opened) == 1
    opened.clear()
    assert look_up(manifest, 4001) == [] and look_up(manifest, -5) == [] and len(opened) <= 1

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from quadrivo.llm.media import _box, _full, boxes, media_digests, probe, probe_column, read_payload, write_container

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("feature", T.StringType())])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(0, 1000))
def test_round_trip(n, seed):
    payload = np.random.default_rng(seed).integers(0, 256, 192 * n, np.uint8).tobytes()
    made = write_container(payload)
    (t,) = probe(made)
    assert read_payload(made, t) == payload
    assert (t.codec, t.handler, t.timescale, t.duration) == ("raw ", "soun", 48000, 192 * n)
    assert [made[a:b] for a, b in t.key_ranges()] == [payload[i * 192 : (i + 1) * 192] for i in range(0, n, 8)]
    assert [k for k, *_ in boxes(memoryview(made), 0, len(made))] == [b"ftyp", b"mdat", b"moov"]


def test_foreign_layouts():
    """Variable sizes, several chunk runs, 64-bit offsets and sizes, all samples keyframes, unknown boxes."""
    sizes, data = [3, 5, 1, 7, 2], bytes(range(18))
    places = [100, 140, 160]
    stbl = _box(b"stbl", _full(b"stsd", struct.pack(">I", 1), _box(b"avc1", bytes(8))), _full(b"stts", struct.pack(">IIIII", 2, 2, 10, 3, 20)), _full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 3, 1, 1)), _full(b"stsz", struct.pack(">II5I", 0, 5, *sizes)), _full(b"co64", struct.pack(">I3Q", 3, *places)))
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQ", 0, 0, 600, 1 << 33), bytes(4), version=1), _full(b"hdlr", bytes(4), b"vide", bytes(13)), _box(b"minf", stbl))
    body = b"".join(data[a:b] for a, b in ((0, 8), (8, 16), (16, 18)))
    mdat = bytearray(200)
    struct.pack_into(">I4sQ", mdat, 0, 1, b"mdat", 200)
    mdat[100:108], mdat[140:148], mdat[160:162] = body[:8], body[8:16], body[16:]
    made = bytes(mdat) + _box(b"free", b"x") + _box(b"moov", _box(b"trak", mdia))
    (t,) = probe(made)
    assert read_payload(made, t) == data and t.codec == "avc1" and t.duration == 1 << 33
    assert t.times.tolist() == [0, 10, 20, 40, 60] and t.keys.all()
    assert t.key_ranges()[1] == (103, 108)
    for bad in (made[:250], b"\0\0\0\x03mdat", struct.pack(">I4s", 8, b"moov") + b"", _box(b"moov", _box(b"trak", b""))):
        try:
            assert probe(bad) == []
        except ValueError:
            pass
    with pytest.raises(ValueError):
        write_container(b"x")


def fragmented(offsets=True):
    """Two fragments of one track: sizes, durations and flags by sample in the first, by default in the second."""
    stbl = _box(b"stbl", _full(b"stsd", struct.pack(">I", 1), _box(b"avc1", bytes(8))), *(_full(k, bytes(4)) for k in (b"stts", b"stsc", b"stco")), _full(b"stsz", bytes(8)))
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0))
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0), bytes(4)), _full(b"hdlr", bytes(4), b"vide", bytes(13)), _box(b"minf", stbl))
    made = _box(b"moov", _box(b"trak", tkhd, mdia), _box(b"mvex", _full(b"trex", struct.pack(">IIIII", 7, 1, 40, 6, 0x10000))))
    samples = [(10, 5, 0), (20, 3, 0x10000), (30, 4, 0x10000)]

    def moof(size):
        run = _full(b"trun", struct.pack(">Ii", 3, size + 8), *(struct.pack(">III", *x) for x in samples), flags=0x701)
        return _box(b"moof", _full(b"mfhd", struct.pack(">I", 1)), _box(b"traf", _full(b"tfhd", struct.pack(">I", 7), flags=0x20000), _full(b"tfdt", struct.pack(">Q", 100), version=1), run))

    made += moof(len(moof(0))) + _box(b"mdat", b"aaaaabbbcccc")
    at = len(made)

    def second(size):
        run = _full(b"trun", struct.pack(">IiI", 2, size + 8, 0), flags=0x5)
        return _box(b"moof", _box(b"traf", _full(b"tfhd", struct.pack(">IQ", 7, at), flags=0x1), run))

    return made + second(len(second(0))) + _box(b"mdat", b"ddddddeeeeee")


def test_fragments():
    made = fragmented()
    (t,) = probe(made)
    assert read_payload(made, t) == b"aaaaabbbccccddddddeeeeee" and t.codec == "avc1"
    assert t.times.tolist() == [100, 110, 130, 160, 200] and t.duration == 240
    assert [made[a:b] for a, b in t.key_ranges()] == [b"aaaaa", b"dddddd"]


def test_compact_sizes():
    payload = bytes(range(21))
    for width, packed in ((4, bytes([0x12, 0x34, 0x56])), (8, bytes([1, 2, 3, 4, 5, 6])), (16, struct.pack(">6H", 1, 2, 3, 4, 5, 6))):
        stbl = _box(b"stbl", _full(b"stsd", struct.pack(">I", 1), _box(b"mp4a", bytes(8))), _full(b"stts", struct.pack(">III", 1, 6, 1)), _full(b"stsc", struct.pack(">IIII", 1, 1, 6, 1)), _full(b"stz2", bytes(3), struct.pack(">BI", width, 6), packed), _full(b"stco", struct.pack(">II", 1, 8)))
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIII", 0, 0, 1, 6), bytes(4)), _full(b"hdlr", bytes(4), b"soun", bytes(13)), _box(b"minf", stbl))
        made = _box(b"mdat", payload) + _box(b"moov", _box(b"trak", mdia))
        (t,) = probe(made)
        assert t.sizes.tolist() == [1, 2, 3, 4, 5, 6] and read_payload(made, t) == payload


def test_false_counts_are_refused(spark):
    """Counts and places that the file can't hold, each an error and none a large allocation."""
    made = write_container(bytes(192 * 40))
    word = lambda kind, skip, value: made[: (at := made.index(kind) + skip)] + struct.pack(">I", value) + made[at + 4 :]
    bad = {
        "stsz": word(b"stsz", 12, 0xFFFFFFFF),
        "stts": word(b"stts", 12, 0xFFFFFFFF),
        "stts ": word(b"stts", 8, 0xFFFFFFFF),
        "stsc": word(b"stsc", 8, 0xFFFFFFFF),
        "stsc ": word(b"stsc", 16, 0),
        "stco": word(b"stco", 12, len(made)),
        "stco ": word(b"stco", 8, 0xFFFFFFF),
        "stss": word(b"stss", 12, 0),
        "stss ": word(b"stss", 12, 41),
    }
    for data in bad.values():
        with pytest.raises(ValueError):
            probe(data)
    rows = probe_column(spark.createDataFrame([*bad.items(), ("good", made)], "doc_id string, media binary")).collect()
    assert {r.doc_id for r in rows if r.error is None} == {"good"} and len(rows) == len(bad) + 1


FUZZ = """
import random, resource, sys
sys.path.insert(0, {root!r})
from quadrivo.llm.media import feature, probe, read_payload, write_container
from tests.llm.test_media import fragmented
size = int(open("/proc/self/statm").read().split()[0]) * 4096
resource.setrlimit(resource.RLIMIT_AS, (size + (1 << 30), size + (1 << 30)))
rng, right = random.Random(7), 0
for i in range(6000):
    data = bytearray(fragmented() if i % 3 == 0 else write_container(bytes(192 * rng.randrange(1, 60))))
    for _ in range(rng.randrange(1, 6)):
        at = rng.randrange(len(data))
        if i % 2:  # in the boxes behind the payload, where the tables are
            at = rng.randrange(max(0, len(data) - 700), len(data))
        size = rng.choice((1, 4))
        data[at : at + size] = rng.choice((bytes(size), b"\\xff" * size, rng.randbytes(size)))
    try:
        for t in probe(bytes(data)):
            assert len(read_payload(bytes(data), t)) == t.sizes.sum() and feature(t)
            right += 1
    except ValueError:
        pass
print(right)
"""


def test_fuzz_under_a_gigabyte():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent.parent)
    done = subprocess.run([sys.executable, "-c", FUZZ.format(root=root)], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and int(done.stdout) > 500, done.stderr[-2000:]


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é" * 300_000, "x"), (4, "a" * 192, "x"), (4, "a" * 192, "x"), (None, "b", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = media_digests(df, media=True).collect()
    assert len(got) == 6
    for r in got:
        t = next(t for k, t, _ in rows if k == r.doc_id)
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.feature.startswith("codec=raw;")
    tracks = probe_column(spark.createDataFrame([(1, bytes(got[0].media)), (2, None), (3, b"zz")], "doc_id long, media binary")).collect()
    assert [t.codec for t in sorted(tracks, key=lambda t: t.doc_id)] == ["raw ", None, None] and {t.doc_id for t in tracks if t.error} == {2, 3}
    assert media_digests(spark.createDataFrame([], SCHEMA)).count() == 0

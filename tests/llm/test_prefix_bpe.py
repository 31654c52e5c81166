import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrivo.llm import queries
from quadrivo.llm.prefix_bpe import Classes, PrefixBpe, Table, bpe_digests, bpe_edit, bpe_encode, bpe_tables
from quadrivo.llm.shared import table

PATHS = {name: P.path(name) for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")}
PATH = PATHS["byte_bpe_50k.tiktoken"]
BPE = PrefixBpe(PATH, P.PATTERN)
PIECES = ["the", " the", "  ", "\n", "\n\n", "'s", "'re", "'", "r", "e", "é", "日本", " ", "\t", "a", "Z", "12", "!!!", "🙂", "\xa0", "’", "ß", "\x1c", "́", "ab" * 40, "\U0001df90", "՘", "\x00"]
texts = st.lists(st.sampled_from(PIECES), max_size=60).map("".join)


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = library(PATH)
CHARS = st.characters(exclude_categories=["Cs"])


@settings(max_examples=400, deadline=None)
@given(texts | st.text(CHARS, max_size=60) | st.text("ab", max_size=300))
def test_ids_are_the_librarys(text):
    ids = BPE.encode([text])[0]
    assert ids == LIBRARY.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


@pytest.mark.parametrize("name", sorted(PATHS))
def test_every_token_is_its_own_encoding(name):
    bpe = PrefixBpe(PATHS[name], P.PATTERN)
    assert [t for t, size in enumerate(bpe.size) if size > 1 and not bpe.split(t)] == []
    assert all(bytes([b]) in bpe.rank for b in range(256))


def test_every_prefix_has_one_last_token():
    raw = "unbelievableness straightforwardly".encode() + b"\xff\x00aaaaaaaa"
    last = []
    BPE.extend(raw, last)
    for i in range(1, len(raw) + 1):
        fit = [t for t in range(len(BPE.token)) if raw[:i].endswith(BPE.token[t]) and (i == BPE.size[t] or BPE.neighbours(last[i - BPE.size[t] - 1], t))]
        assert fit == [last[i - 1]]
        assert BPE.walk(last[:i]) == LIBRARY._encode_single_piece(raw[:i])


def test_characters_that_the_libraries_class_differently():
    made = Classes()
    assert made.as_theirs("abc é 日本") == "abc é 日本"
    seen = made.as_theirs("՘a")
    assert len(seen) == 2 and BPE.encode(["a՘a ՘"])[0] == LIBRARY.encode_ordinary("a՘a ՘")


@settings(max_examples=400, deadline=None)
@given(texts, st.lists(st.tuples(st.integers(0, 200), st.integers(0, 9), texts), max_size=5))
def test_edits_are_exact(text, edits):
    made = BPE.table(text)
    for lo, n, new in edits:
        lo = min(lo, len(text))
        hi = min(len(text), lo + n)
        text = text[:lo] + new + text[hi:]
        made.replace(lo, hi, new)
        fresh = BPE.table(text)
        assert (made.text, made.starts, made.last) == (text, fresh.starts, fresh.last)
        assert made.ids() == LIBRARY.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, max_size=8))
def test_appends_are_exact(parts):
    made = Table(BPE)
    for i, part in enumerate(parts):
        made.append(part)
        assert made.ids() == LIBRARY.encode_ordinary("".join(parts[: i + 1]))


def test_work_is_near_the_edit():
    long = "some words of a text " * 4000
    made = BPE.table(long)
    assert made.found == len(long)
    made.replace(40_000, 40_003, "new")
    assert made.found < 60
    made.append("more")
    assert made.found < 60
    one = BPE.table("abcdefghij" * 4000)  # one pre-token
    one.replace(20_000, 20_001, "xyz")
    assert one.found <= 40_002 and one.ids() == LIBRARY.encode_ordinary("abcdefghij" * 2000 + "xyz" + ("abcdefghij" * 2000)[1:])


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
ROWS = [(1, None, "x"), (2, "", "x"), (3, "hello world " * 6000, "x"), (3, "hello world " * 6000, "x"), (None, "é", None), (4, "x" * 50_000, ""), (5, "日本語" * 3000, "")]


def digests(key, text):
    ids = LIBRARY.encode_ordinary(text or "")
    return (key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_rows(spark):
    got = bpe_digests(spark.createDataFrame(ROWS, SCHEMA), PATH, P.PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digests(k, t) for k, t, _ in ROWS), key=str)
    made = bpe_encode(spark.createDataFrame(ROWS, SCHEMA), PATH, P.PATTERN).where("doc_id = 5").first()
    assert made.ids == LIBRARY.encode_ordinary("日本語" * 3000) and bytes(made.decoded).decode() == "日本語" * 3000
    assert bpe_encode(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).count() == 0


def test_stored_tables_take_edits(spark):
    tables = bpe_tables(spark.createDataFrame(ROWS[:5], SCHEMA), PATH, P.PATTERN)
    edits = tables.withColumn("at", F.when(F.col("doc_id") != 2, F.lit(5))).withColumn("removed", F.lit(3)).withColumn("inserted", F.when(F.col("doc_id") != 1, F.lit("'re new")))
    for r in bpe_edit(edits, PATH, P.PATTERN).collect():
        old = next(t or "" for k, t, _ in ROWS if k == r.doc_id)
        at = len(old) if r.doc_id in (None, 2) else 5
        assert r.text == old[:at] + ("'re new" if r.doc_id not in (None, 1) else "") + old[at + 3 :] or r.doc_id is None
        assert r.ids == LIBRARY.encode_ordinary(r.text) and r.found <= 40


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_prefix_bpe"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digests(r.doc_id, r.text) for r in rows), key=str)

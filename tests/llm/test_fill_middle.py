import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from quadrivo.llm import queries
from quadrivo.llm.fill_middle import BLOCK, MARKS, UNITS, Scan, compose, cut_units, fill_middle, fill_middle_digests
from quadrivo.llm.shared import table

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\x0b\x0c\r]*[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+"}
texts = st.lists(st.sampled_from(["\n", "a", "é", "日本", " ", "<P>", "<", "<S", ">", "word", "x" * 300, "\n\n"]), max_size=40).map("".join)


def brute(key, text, unit="line", rate=100, spm=50):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    assert "".join(units) == text
    lo, hi, draw, order = cut_units(key, 7, len(units))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or draw >= rate:
        return (key, len(units), "plain", None, None, text)
    head, body, tail = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
    if order < spm:
        return (key, len(units), "spm", len(head), len(body), f"<S>{tail}<P>{head}<M>{body}")
    return (key, len(units), "psm", len(head), len(body), f"<P>{head}<S>{tail}<M>{body}")


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6), st.sampled_from(["line", "word"]))
def test_scan_finds_every_unit(pieces, unit):
    scan = Scan(UNITS[unit], [p.encode() for p in pieces])
    state, count = scan.functions()
    marks = Scan(MARKS, [p.encode() for p in pieces]).functions()[0][:, 0] == 3
    for i, p in enumerate(pieces):
        units = re.findall(PATTERNS[unit], p)
        assert count[i, 0] + (state[i, 0] > 0) == len(units)
        assert marks[i] == any(m in p for m in ("<P>", "<S>", "<M>"))
        k = np.arange(1, len(units))
        ends = np.cumsum([len(u.encode()) for u in units])[:-1]
        assert scan.select(np.full(len(k), i), np.zeros(len(k), int), k).tolist() == ends[: len(k)].tolist()


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 50), st.sampled_from(["line", "word"]))
def test_functions_of_chunks_compose(text, size, unit):
    raw = text.encode()
    parts = [raw[i : i + size] for i in range(0, len(raw), size)] or [b""]
    state, count = Scan(UNITS[unit], parts).functions()
    compose(state, count, np.arange(len(parts)))
    whole = Scan(UNITS[unit], [raw]).functions()
    assert state[-1].tolist() == whole[0][0].tolist() and count[-1].tolist() == whole[1][0].tolist()


def test_counts_depend_on_the_start_state():
    _, count = Scan(UNITS["line"], [b"ab\n"]).functions()
    assert count[0].tolist() == [0, 0, 1]
    assert BLOCK < 1000  # the texts below span blocks


ROWS = [(1, None, "x"), (2, "", "x"), (3, "one\ntwo\nthree", "x"), (3, "one\ntwo\nthree", "x"), (None, "é\nä\n\nö", None), (4, "a <M> b\nc", ""), (5, "\n" * 5000, ""), (6, "line é of some words\n" * 9000, "")]
ROWS += [(7, "x" * 70_000, ""), (8, "日本\n" * 30_000, ""), (8, "日本\n" * 30_000, ""), (9, "a\n" * 40_000 + "<S", ""), (10, "a\n" * 40_000 + "<S>", ""), (None, "null\n" * 20_000, "")]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("output", T.StringType())])


@pytest.mark.parametrize("options", [{}, {"giant": 1000, "chunk": 777}, {"unit": "word", "giant": 5000, "chunk": 64 * 50}, {"rate": 40, "spm": 0}])
def test_rows(spark, options):
    got = fill_middle(spark.createDataFrame(ROWS, SCHEMA), **options).collect()
    more = {k: v for k, v in options.items() if k in ("unit", "rate", "spm")}
    assert ordered(got) == ordered(brute(k, t, **more) for k, t, _ in ROWS)


def test_other_keys_and_empty_tables(spark):
    assert fill_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    named = spark.createDataFrame([("a", "x\ny\n"), (None, "x")], "key string, text string")
    assert ordered(fill_middle(named, key="key").collect()) == ordered([brute("a", "x\ny\n"), brute(None, "x")])


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_restore_the_text(spark):
    got = fill_middle_digests(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert ordered(got) == ordered((*b[:5], digest(b[5]), digest(t or "")) for k, t, _ in ROWS for b in [brute(k, t)])


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_fill_middle"](spark, sf).collect()
    assert ordered(got) == ordered((*b[:5], digest(b[5]), digest(r.text or "")) for r in rows for b in [brute(r.doc_id, r.text)])

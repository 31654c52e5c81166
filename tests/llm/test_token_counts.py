import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from quadrivo.llm.byte_bpe import byte_bpe
from quadrivo.llm.token_counts import Resync, token_counts

PATH = P.path("byte_bpe_50k.json")
PIECES = ["the", " the", "  ", "\n", "\n\n", "'s", "'re", "'", "<|endoftext|>", "<|endo", "é", "日本", " ", "\t", "a", "Z", "12", "!!!", "🙂", " ", "’", "ß", "\x1c", "́"]
texts = st.lists(st.sampled_from(PIECES), max_size=60).map("".join)


def exact(text):
    return byte_bpe(PATH).hf.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(texts)
def test_fast_ids_are_the_librarys(text):
    assert byte_bpe(PATH).ids(text).tolist() == exact(text)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(24, 60), st.integers(1, 30))
def test_splices_are_exact(text, chunk, overlap):
    assert Resync(PATH, chunk, overlap).count(text) == len(exact(text))


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "ab " * 3000, "日本語" * 2000, "!" * 3000 + "<|endoftext|>" * 200, "x\n" * 4000])
def test_widening(text):
    assert Resync(PATH, 256, 16).count(text) == len(exact(text))


def test_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world " * 6000, "x"), (3, "hello world " * 6000, "x"), (None, "é", None)]
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, schema), PATH).collect()), key=str)
    n = len(exact("hello world " * 6000))
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 72000, n, True), (3, 72000, n, True), (None, 2, 1, False)], key=str)
    assert token_counts(spark.createDataFrame([], schema), PATH).count() == 0
    assert np.dtype("<u2") == byte_bpe(PATH).dtype

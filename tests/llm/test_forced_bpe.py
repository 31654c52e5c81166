import hashlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from quadrivo.llm.byte_bpe import load_tokenizer
from quadrivo.llm.forced_bpe import ForcedBpe, bpe_round_trip

PATH = P.path("word_bpe_49k.json")
HF, FORCED = load_tokenizer(PATH), ForcedBpe(PATH)
PIECES = ["the", "The", " ", "  ", "\n", "'s", "'", "'re", "<|endoftext|>", "<|startoftext|>", "<|", "é", "é", "́", "İ", "Σ", "日本", "\xa0", " ", "\x85", "\x1c", "\t", "a", "Z", "12", "9", "!!!", ".", ",", "🙂", "’", "ß", "_", "\0", "ǅ", "²"]


def exact(text):
    ids = HF.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), HF.decode(ids, skip_special_tokens=False).encode()


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_exact(text):
    assert FORCED.run([text]) == [exact(text)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_exact_on_any_text(text):
    assert FORCED.run([text]) == [exact(text)]


def test_cuts_are_forced():
    assert FORCED.words and FORCED.joined
    assert FORCED.fragments("ab,cd 12") != ["ab,cd 12"]
    for token in HF.get_vocab():
        assert " " not in token
    assert FORCED.fragments("<|endoftext|>") == ["<|endoftext|>"]


def test_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello, World! " * 9000, "x"), (3, "Hello, World! " * 9000, "x"), (None, "é", None), (4, "x" * 50_000, "")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_round_trip(spark.createDataFrame(rows, schema), PATH, texts=True).collect()}
    want = {(k, len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for k, t, _ in rows for i, d in [exact(t or "")]}
    assert got == want
    assert bpe_round_trip(spark.createDataFrame([], schema), PATH).count() == 0

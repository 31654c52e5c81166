import zlib

import numpy as np
from pyspark.sql import types as T

from quadrivo.llm import queries
from quadrivo.llm.language_id import _clean, hashed, language_id, posterior, train

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])


def test_clean():
    assert [_clean(t) for t in (None, "", " 12!", "Ab, c\nÉ 7日本")] == ["", "", "", " ab c é 日本 "]


def test_hashes_are_even():
    n = np.bincount(hashed(_clean("".join(chr(97 + i * i % 26) + " " * (i % 5 == 0) for i in range(9000)))), minlength=1 << 15)
    assert n.sum() > 20_000 and len(hashed(" a ")) == 6


def test_model_is_multinomial_naive_bayes(spark):
    rows = [(i, t, g, "x") for i, (t, g) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de"), (None, "en"), ("no label", None)] * 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    (model,) = train(df)
    assert model.languages == ["de", "en", "fr"]
    learned = [(t, g) for i, t, g, _ in rows if g and t and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = np.zeros((3, 1 << 15))
    for t, g in learned:
        np.add.at(counts[model.languages.index(g)], hashed(_clean(t)), 1)
    want = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * (1 << 15)))
    assert np.allclose(model.matrix, want)
    text = "the dog and le chat"
    z = model.prior + want[:, hashed(_clean(text))].sum(1)
    names, top, total = model.predict([text, "é" * 10, "", "7"])
    scores = posterior(names, top, total).tolist()
    assert names[0] == model.languages[z.argmax()] and abs(scores[0] - 1 / np.exp(z - z.max()).sum()) < 1e-9
    assert names[2:] == ["und", "und"] and scores[2:] == [0, 0]


def test_any_number_of_languages(spark):
    """300 languages of words of their own: all are learned, and blocks of any size give the same rows."""
    rows = [(i, " ".join(f"{chr(0x4E00 + 7 * (i % 300) + j)}{chr(0x3041 + i % 60)}" for j in range(4)), f"l{i % 300:03}", "x") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, parts = ({r.doc_id: r for r in language_id(df, block=n).collect()} for n in (512, 128))
    assert len(whole) == len(parts) == 3000
    assert all(whole[i].lang_pred == parts[i].lang_pred and abs(whole[i].score - parts[i].score) < 1e-9 for i in whole)
    assert sum(whole[i].lang_pred == g for i, _, g, _ in rows) > 2900 and len({r.lang_pred for r in whole.values()}) == 300


def test_hot_and_null_keys_are_thinned(spark):
    """Null and repeated keys are drawn by their texts, and copies of a row count once."""
    df = spark.range(60_000).selectExpr("if(id % 2 = 0, null, 4) doc_id", "if(id % 3 = 0, 'the same words', concat('word', id)) text", "'en' lang", "'x' score")
    (model,) = train(df, sample=100)
    grams = sum(len(hashed(_clean(t))) for t in ["the same words"] * 2 + ["word12345"] * 100)
    counted = np.exp(model.matrix[0]).max()
    assert model.languages == ["en"] and counted < 1
    total = 0.5 / np.exp(model.matrix[0].min()) - 0.5 * (1 << 15)  # n-grams that were counted
    assert 0.5 * grams < total < 2 * grams


def test_rows(spark):
    rows = [(1, None, "en", "x"), (2, "", "fr", "x"), (3, "word " * 600_000, "en", "x"), (3, "mot", "fr", "x"), (3, "mot", "fr", "x"), (None, "123", None, "x")]
    got = sorted(map(tuple, language_id(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert len(got) == 6 and all(0 <= r[3] <= 1 for r in got)
    assert {r[0] for r in got if r[2] == "und"} == {1, 2, None}
    assert all(r[1] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in got)
    assert language_id(spark.createDataFrame([], SCHEMA)).count() == 0
    assert language_id(spark.createDataFrame([(1, "abc", None, "")], SCHEMA)).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id(docs).filter("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert got > 0.98


def test_query_against_brute_force(spark):
    """Naive Bayes of hashed n-grams, text by text in plain Python."""
    from collections import Counter
    from functools import lru_cache
    from math import exp, log

    sf, buckets, word = "/root/testdata/sf0.01", 1 << 15, (1 << 32) - 1
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]

    @lru_cache(maxsize=None)
    def place(gram):
        h = 0
        for n, c in enumerate(gram, 1):
            h = h * 0x01000193 & word ^ ord(c) * 0x9E3779B1 + n & word
        mixed = h * 0x85EBCA6B & word
        return (mixed ^ mixed >> 15) & buckets - 1

    def grams(text):
        runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        t = f" {' '.join(runs)} " if runs else ""
        return [place(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)]

    learned = [(t, g) for i, t, g in rows if g is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    sizes = Counter(g for _, g in learned)
    assert max(sizes.values()) < 2000  # so that none is left out of the sample
    counts = {g: Counter() for g in sizes}
    for t, g in {(i, t, g): (t, g) for i, t, g in rows if g is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2}.values():
        counts[g].update(grams(t))
    whole = {g: sum(c.values()) + 0.5 * buckets for g, c in counts.items()}
    got = {r.doc_id: r for r in queries.QUERIES["op4_language_id"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        found = grams(t)
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        z = {g: log(sizes[g] / len(learned)) + sum(n * log((counts[g][b] + 0.5) / whole[g]) for b, n in Counter(found).items()) for g in sizes}
        best = max(z.values())
        assert z[r.lang_pred] > best - 1e-6 and abs(r.score - 1 / sum(exp(v - best) for v in z.values())) < 1e-6

import re

import numpy as np
import public_tokenizers as P
from pyspark.sql import types as T

import corpus_pipeline as cp
from quadrivo.llm import co_training, language_id
from quadrivo.llm.byte_bpe import byte_bpe

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("_n", T.StringType())])


def one_of_each(rows):
    """Brute force: rows by group of near duplicates (Jaccard similarity of five-word shingles), the first by id (null last) and text hash."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    return [r for i, r in enumerate(rows) if root[i] == i]


def test_near_duplicate_stage(spark):
    long = " ".join(f"w{i * i % 97}" for i in range(300))
    rows = [(5, long, "en", "a", 1, "x"), (3, long, "en", "b", 1, "x"), (3, long, "en", "b", 1, "x"), (None, long, "en", "b", 1, "x"), (None, "other words here for one", None, None, None, None), (None, "quite different words in this", None, None, None, None), (9, None, "en", "a", 0, "x"), (8, "", "en", "a", 0, "x")]
    got = sorted(map(tuple, cp.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), SF).collect()), key=str)
    assert got == sorted(one_of_each(rows), key=str)
    assert cp.near_duplicate_stage(spark, spark.createDataFrame([], DOCS), SF).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    (model,) = language_id.train(docs)
    found = model.predict([r[1] for r in rows])
    names, scores = found[0], language_id.posterior(*found)
    rows = [r for r, n, s in zip(rows, names, scores) if n != "und" and s >= 0.5]
    left = spark.createDataFrame(rows, docs.schema)
    classifier = co_training.train(left, spark.read.parquet(f"{SF}/labels.parquet"))
    zt = np.array([classifier.text_score(r[1]) for r in rows])
    f = classifier.meta_features(np.array([co_training.numbers(r[1]) for r in rows]), np.array([co_training.categories(r[3], r[2]) for r in rows]))
    p = classifier.combine(zt, classifier.meta[f].sum(1) + classifier.meta[-1])[2]
    rows = one_of_each([r for r, q in zip(rows, p) if q >= 0.5])
    got = cp.run(spark, SF).collect()
    bpe = byte_bpe(P.path("byte_bpe_50k.json"))
    want = {r[0]: len(bpe.hf.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows}
    assert {r.doc_id: r.doc_tokens for r in got} == want and len(want) > 100
    ids = {}
    for r in sorted(got, key=lambda r: r.start):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u2").tolist())
    assert all(ids[r[0]] == [*bpe.hf.encode(r[1], add_special_tokens=False).ids, 1] for r in rows)
    total = {}
    for r in got:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert sum(total.values()) == sum(want.values()) and all(n == 2048 or n & (n - 1) == 0 for n in total.values())


def test_near_duplicate_stage_takes_columns_without_order(spark):
    df = spark.createDataFrame([(1, "one text here", "en", "s", {"a": 1}), (1, "one text here", "en", "s", {"a": 1}), (2, "another text there", "en", "s", None)], "doc_id long, text string, lang string, source string, more map<string,int>")
    got = cp.near_duplicate_stage(spark, df, SF).collect()
    assert sorted(r.doc_id for r in got) == [1, 2] and {r.more["a"] for r in got if r.more} == {1}


def test_stages_take_hard_rows(spark):
    rows = [(None, None, None, None, None, None), (1, "", "en", "s", 0, "x"), (1, "the words of a text", "en", "s", 1, "x"), (1, "the words of a text", "en", "s", 1, "x"), (2, "les mots d'un texte " * 30_000, "fr", None, 1, None)]
    for data in (rows, []):
        df = spark.createDataFrame(data, DOCS)
        for _, stage in cp.STAGES:
            stage(spark, df, SF).count()
        for _, stage in cp.STAGES[:-1]:
            assert stage(spark, df, SF).columns == df.columns

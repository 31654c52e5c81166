import tracemalloc

import numpy as np
from pyspark.sql import types as T

from quadrivo.llm import co_training as ct
from quadrivo.llm.co_training import NUMBERS, Rows, Sparse, fit, learn, quality_classifier, sigmoid, surest, verdicts

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("kept", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
SF = "/root/testdata/sf0.01"


def test_sparse_regression_against_dense():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(20) < 0.3) for _ in range(400)]
    y = np.array([float(3 in r or 7 in r) for r in rows])
    x = Sparse(rows, 20)
    dense = np.zeros((400, 21))
    for i, r in enumerate(rows):
        dense[i, r], dense[i, 20] = 1, 1
    w = rng.random(21)
    assert np.allclose(x.dot(w), dense @ w) and np.allclose(x.back(y), dense.T @ y)
    part = x.take(np.array([5, 2, 9]))
    assert np.allclose(part.dot(w), (dense @ w)[[5, 2, 9]])
    z = x.dot(fit(x, y, np.ones(400), 1)[0])
    assert ((sigmoid(z) > 0.5) == (y > 0.5)).mean() > 0.97


def test_views_teach_each_other():
    """Labels hold a word or two of each class's thousands; metadata know the pool's answers and hand them over."""
    rng = np.random.default_rng(1)
    n, known = 12_000, 1200
    truth = rng.integers(0, 2, n)
    values = rng.random((n, len(NUMBERS)))
    values[:, 3] = truth * 0.5 + rng.random(n) * 0.45
    texts = [np.unique(rng.integers(0, 2000, 8) + 2000 * t) for t in truth]
    rows = Rows(np.arange(n), np.concatenate([values, np.zeros((n, 2))], 1), np.concatenate(texts), np.array(list(map(len, texts))))
    pool = rows.take(np.arange(known, n))

    def exchange(model, told):
        return [(rows.take(ids), good) for ids, _, good, _ in verdicts(model, pool, told, 1000)]

    def right(rounds):
        m = learn(rows.take(np.arange(known)), truth[:known], np.arange(known) >= 900, exchange, rounds)
        return ((rows.scores(m)[0] > 0) == truth)[known:].mean()

    alone, taught = right(0), right(3)
    print(alone, taught)
    assert taught > alone + 0.02 and taught > 0.9


def test_learning_holds_no_wide_form_of_all_features():
    """The driver learns from millions of words in a few bytes for each of them."""
    rng = np.random.default_rng(3)
    n, each = 4_000, 1_000
    flat = np.sort(rng.integers(0, ct.WORDS, (n, each)), 1).astype("<u2").ravel()
    rows = Rows(np.arange(n), np.concatenate([rng.random((n, len(NUMBERS))), np.zeros((n, 2))], 1), flat, np.full(n, each))
    tracemalloc.start()
    try:
        learn(rows, rng.integers(0, 2, n), np.arange(n) % 4 == 0, lambda model, told: [], 0)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8 * len(flat)


def test_features_in_pieces(monkeypatch):
    """Pieces of any size give the same sums and scores, empty rows and rows larger than a piece among them."""
    rng = np.random.default_rng(4)
    sizes = np.array([0, 3, 0, 0, 25, 1, 7, 0, 12, 0])
    rows = Rows(np.arange(10), np.concatenate([rng.random((10, len(NUMBERS))), np.zeros((10, 2))], 1), rng.integers(0, ct.WORDS, sizes.sum()).astype("<u2"), sizes)
    model = ct.Model(np.sort(rng.random((len(NUMBERS), ct.BINS))), rng.random(ct.WORDS + 1), rng.random(ct._meta_size() + 1), [], np.empty(0))
    w, g = rng.random(ct.WORDS + 1), rng.random(10)
    texts = np.split(rows.flat, np.cumsum(sizes)[:-1])
    for piece in (1, 2, 8, 1 << 18):
        monkeypatch.setattr(ct, "PIECE", piece)
        x = rows.view(model, 0)
        assert np.allclose(x.dot(w), [w[t].sum() + w[-1] for t in texts])
        assert np.allclose(x.back(g), np.bincount(np.concatenate([*texts, np.full(10, ct.WORDS)]).astype(int), np.r_[np.repeat(g, sizes), g], ct.WORDS + 1))
        assert np.allclose(rows.scores(model)[0], [model.text[t].sum() + model.text[-1] for t in texts])
        assert np.allclose(rows.scores(model)[1], rows.view(model, 1).dot(model.meta))


def test_surest_of_parts_is_surest_of_all():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 60, 400)
    sure, n = ids % 7 / 10, ids * 3
    good = ids % 3 == 0
    parts = [surest(*(c[i::4] for c in (ids, sure, good, n)), 8) for i in range(4)]
    whole = surest(ids, sure, good, n, 8)
    joined = surest(*(np.concatenate(c) for c in zip(*parts)), 8)
    assert all((a == b).all() for a, b in zip(whole, joined))
    want = sorted({(-s, i) for i, s, g in zip(ids.tolist(), sure.tolist(), good.tolist()) if g})[:8]
    assert sorted((-s, i) for i, s, g in zip(whole[0].tolist(), whole[1].tolist(), whole[2].tolist()) if g) == want


def plain_features(text, source, lang):
    """A document's features from its text, by plain means."""
    import re
    import zlib

    seen = re.findall(r"\w+", (text or "").lower())
    found = {zlib.crc32(w.encode()) % ct.WORDS for w in seen + [f"{w[:n]}*" for w in seen for n in (4, 6) if len(w) > n]}
    return ct.numbers(text) + [zlib.crc32(f"{i}:{v}".encode()) % ct.CATEGORIES for i, v in enumerate((source, lang))], sorted(found)


def test_query_against_brute_force(spark):
    """The exchange by a sorted list of all unlabelled documents in one place, and every document's verdict from its text."""
    sf = SF.replace("0.01", "0.001")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    ids = {r.doc_id: r._id for r in ct.features(docs, "text", "doc_id", "source", "lang").withColumnRenamed("_key", "doc_id").collect()}
    made = {}
    for r in docs.collect():
        made[ids[r.doc_id]] = plain_features(r.text, r.source, r.lang)
    y = {}
    for r in labels.collect():
        if r.doc_id in ids and r.quality is not None:
            i, good = ids[r.doc_id], int(r.quality == 1 and not r.toxic)
            y[i] = min(good, y.get(i, 1))

    def rows(keys):
        return Rows(np.array(keys, np.int64), np.array([made[i][0] for i in keys]).reshape(-1, ct.META), np.array([w for i in keys for w in made[i][1]], "<u2"), np.array([len(made[i][1]) for i in keys], np.int64))

    def exchange(model, told):
        def z(i):
            numbers, words = made[i]
            m = model.meta[-1] + sum(model.meta[j * (ct.BINS + 1) + sum(e <= numbers[j] for e in model.edges[j])] for j in range(len(NUMBERS))) + sum(model.meta[len(NUMBERS) * (ct.BINS + 1) + int(c)] for c in numbers[-2:])
            return model.text[-1] + sum(model.text[w] for w in words), m

        scores, out = {i: [float(sigmoid(x)) for x in z(i)] for i in made}, []
        for view in (0, 1):
            best = []
            for good in (True, False):
                some = []
                for i, p in scores.items():
                    own, there = p[1 - view], p[view]
                    opposed = (own > 0.5) != (there > 0.5)
                    if i not in told[view] and max(own, 1 - own) >= ct.CONFIDENT and not opposed and (own > 0.5) == good:
                        some.append((-round(abs(own - 0.5), 12), i))
                best += [(i, good) for _, i in sorted(some)[: ct.HANDED]]
            best.sort()
            out.append((rows([i for i, _ in best]), np.array([g for _, g in best], bool)))
        return out

    keys = sorted(y)
    model = learn(rows(keys), np.array([y[i] for i in keys]), np.array([i % 4 == 0 for i in keys]), exchange)
    every = rows(sorted(made))
    want = dict(zip(every.ids.tolist(), model.combine(*every.scores(model))[2].tolist()))
    got = quality_classifier(docs, labels).collect()
    assert len(got) == docs.count()
    assert max(abs(r.quality_prob - want[ids[r.doc_id]]) for r in got) < 1e-6


def test_rows_at_the_driver_are_bounded(spark, monkeypatch):
    """Keys that repeat without end, or are null, bring no more rows to the driver than the sample and the verdicts."""
    docs = spark.range(200_000).selectExpr("if(id % 3 = 0, null, id % 2) doc_id", "concat('word', id, ' of ', id % 90, ' more') text", "'en' lang", "concat('s', id % 2) source")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (0, 1, 0)], LABELS)
    held, handed, plain = [], [], ct.learn

    def spy(rows, y, calibration, exchange, rounds):
        held.append(len(rows.ids))

        def told(*a):
            given = exchange(*a)
            handed.append(max(len(r.ids) for r, _ in given))
            return given

        return plain(rows, y, calibration, told, rounds)

    monkeypatch.setattr(ct, "learn", spy)
    got = quality_classifier(docs, labels, sample=1000)
    assert got.count() == 200_000
    assert 0 < held[0] < 2000 and max(handed) <= 2 * ct.HANDED and len(handed) == ct.ROUNDS
    few = ct.co_train(ct.features(docs, "text", "doc_id", "source", "lang"), labels, sample=1000, most_words=800)
    assert held[1] < 800 and few.text.any()


def test_long_texts_are_handed_over_too(spark, monkeypatch):
    """Unlabelled texts of tens of thousands of distinct words: as many verdicts of a class are handed over as of short ones."""
    docs = spark.range(400).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, if(id < 200, 20, 30000)), i -> concat(if(id % 2 = 0, 'good', 'bad'), i, if(i % 7 = 0, string(id), '')))) text", "'en' lang", "concat('s', id % 2) source")
    labels = docs.filter("doc_id < 200").selectExpr("doc_id", "int(doc_id % 2 = 0) quality", "0 toxic")
    handed, plain = [], ct.learn

    def spy(rows, y, calibration, exchange, rounds):
        def told(*a):
            given = exchange(*a)
            handed.append([len(r.ids) for r, _ in given])
            return given

        return plain(rows, y, calibration, told, rounds)

    monkeypatch.setattr(ct, "learn", spy)
    monkeypatch.setattr(ct, "CONFIDENT", 0.5)
    ct.train(docs, labels)
    assert max(handed[0]) == 2 * ct.HANDED and min(handed[0]) >= ct.HANDED  # the views have to agree, so one class may have none


def test_rows(spark):
    rows = [(1, None, None, None, "x"), (2, "", "en", "s", "x"), (3, "word " * 100_000, "en", "s", "x"), (4, "a", "en", "s", "x"), (4, "a", "en", "s", "x"), (None, "é", "fr", None, "x")]
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)
    got = quality_classifier(docs, none).collect()
    assert len(got) == 6 and all(r.kept and r.quality_prob == 0.5 for r in got)
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 1), (4, None, 0), (None, 1, 1)], LABELS)
    assert quality_classifier(docs, labels).count() == 6
    assert quality_classifier(docs.limit(0), labels).count() == 0


def test_on_documents(spark):
    sf = SF.replace("0.01", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learned = labels.filter("pmod(hash(doc_id), 4) <> 1")
    got = quality_classifier(docs, learned).join(labels.filter("pmod(hash(doc_id), 4) = 1"), "doc_id")
    r = got.selectExpr("avg(if(quality = 1 and toxic = 0, int(kept), null)) good", "avg(if(quality = 0, int(kept), null)) bad", "avg(if(toxic = 1, int(kept), null)) toxic").first()
    print(r)
    assert r.good > 0.97 and r.bad < 0.1 and r.toxic < 0.15

import math
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrivo.llm.quality_rules import BASE, BINS, FEATURES, MAX_CONDITIONS, MAX_RULES, MIN_COVER, PRECISION, learn, quality_rules, statistics, train

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("text", T.StringType())])
SF = "/root/testdata/sf0.01"


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows, marked = {}, set()
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            marked |= {i + k for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_statistics(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "\x0ba\x0cb\rc", "a b c a b c", "x\nx\n x\n\n \nx", "é#🙂 |", "\xa0 a", "w " * 40_000]
    texts += ["".join(rng.choice(["a", "b", "c#", "é"]) + rng.choice([" ", " ", "\n", "  ", " \t"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r[c] for c in BASE) for r in statistics(df, keep=["doc_id"]).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_learning_covers_planted_rules(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        f = {"n_words": rng.randrange(50, 500), "mean_word": rng.random() * 9, "symbol_share": rng.random(), "dup_line_share": 0.0, "repeat_share": rng.random(), "upper_share": rng.random(), "bang_share": 0.0, "distinct_share": rng.random()}
        rows.append((*f.values(), int(f["symbol_share"] > 0.9 or f["upper_share"] > 0.8 and f["repeat_share"] > 0.5), i % 3))
    df = spark.createDataFrame(rows, [*f, "bad", "fold"])
    model = learn(df)
    right = df.select(F.avg((model.keeps() == (F.col("bad") == 0)).cast("int"))).first()[0]
    assert right > 0.97 and 2 <= len(model.rules) <= 8
    assert "symbol_share >" in str(model) and "upper_share >" in str(model)
    assert learn(df.filter("bad = 0")).rules == () and learn(df.limit(0)).rules == ()


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word other thing " * 30_000, "x"), (4, " ".join(f"w{i}" for i in range(60)), "x"), (4, " ".join(f"w{i}" for i in range(60)), "x"), (None, "a", None)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    got = sorted((r.doc_id or 0, r.base_failed, r.kept) for r in quality_rules(docs, none).collect())
    assert got == [(0, True, False), (1, True, False), (2, True, False), (3, True, False), (4, False, True), (4, False, True)]
    labels = spark.createDataFrame([(4, 0, "x"), (4, 1, "x"), (None, 1, ""), (3, None, "")], LABELS)
    assert quality_rules(docs, labels).filter("kept").count() == 2
    assert quality_rules(docs.limit(0), labels).count() == 0


def test_on_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules(docs, labels)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    right = got.filter("not base_failed").join(labels, "doc_id").selectExpr("avg(int(kept = (quality = 1)))", "avg(if(quality = 1, int(kept), null))").first()
    assert right[0] > 0.95 and right[1] > 0.97
    print(train(docs, labels))


def brute_list(rows):
    """The decision list by counting rows one by one: rows of (features, bad, fold)."""
    thresholds = {}
    for f in FEATURES:
        seen = set()
        for kind in (0, 1):
            have = sorted(r[0][f] for r in rows if r[1] == kind)
            seen |= {have[max(0, math.ceil(i * len(have) / BINS) - 1)] for i in range(BINS + 1)} if have else set()
        v = sorted(seen)
        if len(v) > 1:
            thresholds[f] = [(x + y) / 2 for x, y in zip(v, v[1:])]
    holds = lambda r, rule: all((r[0][f] > t) == above for f, above, t in rule)
    rules = []
    while len(rules) < MAX_RULES:
        left = [r for r in rows if not any(holds(r, rule) for rule in rules)]
        rule = []
        while len(rule) < MAX_CONDITIONS:
            here = [r for r in left if r[2] < 2 and holds(r, rule)]
            p_all = sum(r[1] for r in here)
            if not p_all or p_all == len(here):
                break
            best, most = None, 1e-9
            for f in sorted(thresholds):
                for t in thresholds[f]:
                    for above in (True, False):
                        covered = [r[1] for r in here if (r[0][f] > t) == above]
                        p = sum(covered)
                        gain = p * (math.log2(p / len(covered)) - math.log2(p_all / len(here))) if p else 0
                        if gain > most:
                            best, most = (f, above, t), gain
            if not best:
                break
            rule.append(best)
        if not rule:
            break
        worth = []
        for i in range(1, len(rule) + 1):
            covered = [r[1] for r in left if r[2] == 2 and holds(r, rule[:i])]
            worth.append((round(2 * sum(covered) / len(covered) - 1 if covered else -1, 3), -i, len(covered)))
        value, size, n = max(worth)
        if (value + 1) / 2 < PRECISION or n < MIN_COVER:
            break
        rules.append(rule[:-size])
    return rules


def test_query_against_brute_force(spark):
    sf = SF
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    y = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            y.setdefault(r.doc_id, []).append(r.quality)
    made = statistics(docs).withColumn("fold", F.expr("pmod(xxhash64('fold', doc_id), 3)")).collect()
    passed = [r for r in made if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words]
    rows = [({f: float(r[f]) for f in FEATURES}, int(sum(y[r.doc_id]) / len(y[r.doc_id]) < 0.5), r.fold) for r in passed if r.doc_id in y]
    rules = brute_list(rows)
    assert rules
    want = {r.doc_id: r in passed and not any(all((float(r[f]) > t) == above for f, above, t in rule) for rule in rules) for r in made}
    assert {r.doc_id: r.kept for r in quality_rules(docs, labels).collect()} == want


def test_a_hot_key_is_thinned_by_its_texts(spark, monkeypatch):
    from quadrivo.llm import quality_rules as qr

    docs = spark.range(30_000).selectExpr("if(id % 4 = 0, null, 7) doc_id", "concat_ws(' ', 'some words', id % 9000, 'and more')  text", "'x' extra")
    seen, plain = [], qr.learn
    monkeypatch.setattr(qr, "MIN_WORDS", 1)
    monkeypatch.setattr(qr, "learn", lambda rows: seen.append(rows.count()) or plain(rows))
    labels = spark.createDataFrame([(7, 1, "x"), (7, 1, "y"), (None, 0, "z")], LABELS)
    train(docs, labels, sample=500)
    assert 0 < seen[0] < 700

import random
from functools import lru_cache

import corpus_pipeline as cp
from quadrivo.llm.simhash import fingerprint
from tests.llm.test_pipeline import DOCS, SF


@lru_cache(maxsize=None)
def plain_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(s, t):
    a, b = plain_set(s), plain_set(t)
    return len(a & b) / len(a | b)


def left(texts):
    """Brute force: the first of each group."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def test_near_copies_beyond_four_bits_go(spark):
    rng = random.Random(3)
    texts, passage = [], " ".join(f"common{i}" for i in range(40))
    for i in range(60):
        words = rng.choices([f"w{j}" for j in range(500)], k=rng.randrange(6, 400))
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other"])
            texts.append(" ".join(copy) + (" " + passage if i % 3 == 0 else ""))
    texts += ["", "one two", "One  two", "x y z"]
    pairs = [(s, t) for i, s in enumerate(texts) for t in texts[:i] if jaccard(s, t) >= 0.8]
    assert any((fingerprint(s) ^ fingerprint(t)).bit_count() > 4 for s, t in pairs)
    rows = [(i, t, "en", "s", len(t), None) for i, t in enumerate(texts)]
    got = {r.doc_id for r in cp.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    assert got == left(texts) and len(got) < len(texts)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Some hundred near copies of one text, others that are only linked over others, and texts that share a passage alone; pairs grow with the copies, not their square."""
    from quadrivo.llm import near_copies as nc

    rng = random.Random(4)
    passage, texts = [f"shared{i}" for i in range(30)], []
    base = [f"w{rng.randrange(900)}" for _ in range(250)]
    for i in range(250):
        words = list(base)
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    for i in range(20):  # a chain: each like the one before only
        base = [f"c{i}x{j}" if 9 * i <= j < 9 * i + 9 else w for j, w in enumerate(base)]
        texts.append(" ".join(base))
    texts += [" ".join([f"u{i}x{j}" for j in range(rng.randrange(5, 60))] + passage) for i in range(120)]
    rng.shuffle(texts)
    compared, plain = [], nc._verified
    monkeypatch.setattr(nc, "CROWDED", 8)  # so that groups of this size are crowded
    monkeypatch.setattr(nc, "ROUNDS", 6)
    monkeypatch.setattr(nc, "_verified", lambda pairs, held: compared.append(pairs.count()) or plain(pairs, held))
    rows = [(i, t, "en", "s", len(t), None) for i, t in enumerate(texts)]
    got = {r.doc_id for r in nc.near_copies(spark.createDataFrame(rows, DOCS)).filter("doc_id = component_id").collect()}
    print(compared)
    assert got == left(texts) and 120 < len(got) < 200
    assert len(compared) > 2 and sum(compared) < 4000  # 31,125 pairs among the copies alone


def groups_of(rows):
    """Brute force: the smallest key of each row's group (null where all of it are null)."""
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return sorted(((k, min((q for (q, _), r in zip(rows, root) if r == mine and q is not None), default=None)) for (k, _), mine in zip(rows, root)), key=str)


def test_null_and_repeated_keys(spark):
    from quadrivo.llm.near_copies import near_copies

    base = " ".join(f"w{i}" for i in range(40))
    rows = [(None, base), (None, base + " more"), (3, base + " more words"), (3, "a text of its own that is long enough"), (3, "another one under the same key as that"), (4, "another one under the same key as that"), (None, None), (None, ""), (7, " "), (None, "alone"), (9, base), (9, base)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, key string, row string")
    assert sorted(map(tuple, near_copies(df).collect()), key=str) == groups_of(rows)
    assert near_copies(df.limit(0)).count() == 0


def test_crowds_that_share_a_passage(spark, monkeypatch):
    """Many texts that share a long passage, no shingle of which the sample finds; pairs of them that are alike besides are all found, and few others are compared."""
    from quadrivo.llm import near_copies as nc

    rng = random.Random(6)
    passage, rows = " ".join(f"p{i}" for i in range(60)), []
    for i in range(150):
        own = [f"u{i}x{j}" for j in range(rng.randrange(30, 60))]
        rows.append((2 * i, " ".join(own) + " " + passage))
        if i % 10 == 0:
            own[rng.randrange(len(own))] = "changed"
            rows.append((2 * i + 1, " ".join(own) + " " + passage))
    compared, plain, anew = [], nc._verified, []
    again = nc._rarest_first
    monkeypatch.setattr(nc, "MOST", 0)
    monkeypatch.setattr(nc, "CROWDED", 8)
    monkeypatch.setattr(nc, "_verified", lambda pairs, held: compared.append(pairs.count()) or plain(pairs, held))
    monkeypatch.setattr(nc, "_rarest_first", lambda *given: anew.append(1) or again(*given))
    got = sorted(map(tuple, nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == groups_of(rows) and anew
    print(compared)
    assert compared[-1] < 300  # of 13,530 pairs that share the passage


def test_sketches_differ_by_no_more_than_the_sets():
    import numpy as np

    from quadrivo.llm.near_copies import WORDS, odd_sketch

    rng = np.random.default_rng(1)
    for n in (1, 5, 100, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        for change in (0, 1, n // 3):
            b = np.unique(np.r_[a[change:], rng.integers(0, 1 << 63, change).astype(np.uint64)])
            apart = int(np.bitwise_count((odd_sketch(a) ^ odd_sketch(b)).view(np.uint64)).sum())
            different = len(np.setxor1d(a, b))
            assert len(odd_sketch(a)) == WORDS and apart <= different and (different - apart) % 2 == 0
            assert not 0 < different < 20 or apart > 0


def test_pairs_are_made_once_not_for_each_shingle(spark, monkeypatch):
    """Texts that share most of their shingles and are not connected: their pairs are made about once, and those that are alike besides are found."""
    from pyspark.sql import functions as F

    from quadrivo.llm import near_copies as nc

    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(400)], []
    for i in range(30):
        words = [f"n{i}x{j}" if (j + 2 * i) % 50 == 0 else w for j, w in enumerate(base)]
        rows.append((2 * i, " ".join(words)))
        if i % 10 == 0:
            words[rng.randrange(len(words))] = "changed"
            rows.append((2 * i + 1, " ".join(words)))
    made, plain = [], nc._met
    monkeypatch.setattr(nc, "_met", lambda *given: made.append(plain(*given).agg(F.count("*"), F.countDistinct("a", "b")).first()) or plain(*given))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for heavy in (0, 1 << 30):  # with sketches and without
        monkeypatch.setattr(nc, "HEAVY", heavy)
        made.clear()
        assert sorted(map(tuple, nc.near_copies(df).collect()), key=str) == groups_of(rows)
        print(made)
        assert sum(n for n, _ in made) <= 1.5 * sum(pairs for _, pairs in made) and (not heavy or sum(pairs for _, pairs in made) > 100)


def test_wide_sketches_of_any_two_lengths():
    import numpy as np

    from quadrivo.llm.near_copies import apart, wide_sketch

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (1, 200, 257, 600, 5000)]
    sets += [np.unique(np.r_[s[len(s) // 10 :], rng.integers(0, 1 << 64, len(s) // 8, np.uint64)]) for s in sets]
    for a in sets:
        assert 8 * len(wide_sketch(a)) >= 2 * len(a) and apart(wide_sketch(a), wide_sketch(a)) == 0
        for b in sets:
            n, different = apart(wide_sketch(a), wide_sketch(b)), len(np.setxor1d(a, b))
            assert n <= different and (n - different) % 2 == 0 and n == apart(wide_sketch(b), wide_sketch(a))
    assert 9 * apart(wide_sketch(sets[4]), wide_sketch(np.unique(rng.integers(0, 1 << 64, 5000, np.uint64)))) > 10_000  # a short sketch can't tell these

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import types as T

from quadrivo.llm.byte_bpe import byte_bpe
from quadrivo.llm import packing
from quadrivo.llm.packing import Schedule, pack

PATH = P.path("byte_bpe_50k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("offset", T.StringType())])


def simulate(lengths, quanta, begin, unit):
    """Deficit round-robin, a round at a time: the queue and place of each token in order."""
    deficit, at, out = list(map(int, begin)), [0] * len(lengths), []
    while any(a < n for a, n in zip(at, lengths)):
        for s, n in enumerate(lengths):
            deficit[s] += int(quanta[s])
            units = deficit[s] // (unit << 16)
            deficit[s] -= units * (unit << 16)
            take = min(n - at[s], units * unit)
            out += [(s, at[s] + i) for i in range(take)]
            at[s] += take
    return out


@pytest.mark.parametrize("seed", range(12))
def test_schedule_is_deficit_round_robin(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 5, 300, 2000]) + rng.randrange(50) for _ in range(rng.randrange(1, 7))]
    weights = None if seed % 2 else [rng.random() + 0.01 for _ in lengths]
    plan = Schedule(lengths, weights, 64, 4)
    order = simulate(lengths, plan.quanta, plan.begin, 4)
    spans = [(s, a, min(n - a, 37)) for s, n in enumerate(lengths) for a in range(0, n, 37)]
    of, start, n, seq, offset = plan.pieces(*(np.array(x, np.int64) for x in zip(*spans)))
    base = {i: i * 64 for i in range(plan.full)} | {plan.full + i: int(t) for i, t in enumerate(plan.tail[:-1])}
    got = {}
    for o, a, k, q, f in zip(of, start, n, seq, offset):
        s, b, _ = spans[o]
        for i in range(k):
            got[base[q] + f + i] = (s, b + a + i)
    assert [got[i] for i in range(len(order))] == order and len(got) == len(order)


def test_windows_hold_the_targets():
    lengths = [400_000, 60_000, 39_000, 1_000]
    plan = Schedule(lengths)
    of, _, n, seq, _ = plan.pieces(np.arange(4), np.zeros(4, np.int64), np.array(lengths))
    share = np.zeros((plan.full, 4))
    np.add.at(share, (seq[seq < plan.full], of[seq < plan.full]), n[seq < plan.full])
    assert (share.sum(1) == 2048).all()
    assert np.abs(share - 2048 * np.array(lengths) / 500_000)[:-1].max() <= 4 * 32


def test_pack(spark, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "é <|endoftext|> x", "long " * 20_000, *(" ".join(rng.choices(["ab", "c", "the"], k=rng.randrange(300))) for _ in range(200))]
    rows = [(i, t, rng.choice(["a", "a", "a", "b", None, f"s{i}"]), "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bpe = byte_bpe(PATH)
    for few, kind in ((packing.ONE_NODE, {}), (3, {}), (packing.ONE_NODE, {"weights": {"a": 0.9, "b": 0.1}})):
        monkeypatch.setattr(packing, "ONE_NODE", few)  # 3: a tree with nodes below the root
        got = pack(df, PATH, **kind).collect()
        pieces, seqs = defaultdict(list), defaultdict(list)
        for r in got:
            pieces[r.doc_id].append(r)
            seqs[r.sequence_id].append(r)
        assert sorted(pieces) == list(range(len(rows)))
        for i, t, *_ in rows:
            ids = [*(bpe.hf.encode(t, add_special_tokens=False).ids if t else []), 1]
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                part = ids[at : at + r.length]
                assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and np.frombuffer(r.ids, "<u2").tolist() == part
                at += r.length
            assert at == len(ids)
        for s, rs in seqs.items():
            at = 0
            for r in sorted(rs, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at == 2048 or at & (at - 1) == 0
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_repeated_and_null_keys_are_documents_of_their_own(spark):
    rows = [(5, "same words", "a", "x")] * 7 + [(None, "same words", None, "x")] * 3
    got = pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    one = len(byte_bpe(PATH).hf.encode("same words", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got) == 10 * one and all(r.doc_tokens == one for r in got)
    places = sorted((r.sequence_id, r.offset + i) for r in got for i in range(r.length))
    assert len(set(places)) == 10 * one


def test_a_thousand_sources(spark):
    """Every source has a queue of its own: all tokens are packed once, and windows hold the large sources' shares and no source's tokens in one lump."""
    words = " ".join(["the"] * 40)
    rows = [(i, words * (40 if i % 2 else 1), "big" if i % 2 else f"s{i % 2000}", "x") for i in range(6000)]
    got = pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    bpe = byte_bpe(PATH)
    size = {t: len(bpe.hf.encode(t, add_special_tokens=False).ids) + 1 for t in {r[1] for r in rows}}
    assert sum(r.length for r in got) == sum(size[r[1]] for r in rows)
    assert len({r.queue for r in got}) == 1001
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    total = sum(size[r[1]] for r in rows)
    big, sequences = sum(size[r[1]] for r in rows if r[2] == "big"), defaultdict(int)
    for r in got:
        sequences[r.sequence_id] += r.length * (r.queue == "big")
    # The last part-filled unit of each of 256 nodes comes when its deficit is a whole unit, so the stream's end has the small sources' rests.
    full = [sequences[s] for s in range(total // 2048 - 256 * 32 // 2048)]
    assert len(full) > 2000 and max(abs(n - 2048 * big / total) for n in full) < 300
    assert np.std([sum(full[i : i + 8]) for i in range(0, len(full) - 8, 8)]) < 0.01 * 8 * 2048  # deviations even out over windows


def test_weights_of_zero_do_not_overflow():
    """A long queue without a share is served after the others, however many rounds that is."""
    plan = Schedule([10**7, 5000], [0.0, 1.0])
    of, start, n, place = plan.spread(np.array([0, 1]), np.array([0, 0]), np.array([10**7, 5000]))
    order = np.argsort(place)
    assert (np.r_[place[order], 10**7 + 5000] == np.r_[0, np.cumsum(n[order])]).all()


@pytest.mark.parametrize("seed", range(4))
def test_nested_schedule_is_nested_round_robin(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(packing, "ONE_NODE", 3)
    lengths = {(f"s{i}" if i else None): rng.randrange(1, 400) for i in range(14)}
    totals = spark.createDataFrame([(s, i % 2, n // 2 if i % 2 else n - n // 2) for s, n in lengths.items() for i in range(2)], "source string, task int, n long")
    weights = {s: rng.random() for s in lengths} if seed % 2 else None
    leaves, nodes = packing._tree(totals, weights)
    leaf = {r.source: (r.node, r.child) for r in leaves.collect()}
    children = {r.node: r.children for r in nodes.collect()}
    tree = packing.Tree("", 64, 4)
    tree.node = lambda number: (Schedule([c.tokens for c in children[number]], [c.weight for c in children[number]], 64, 4), np.array([c.child for c in children[number]]))

    def stream(number):
        plan, kids = tree.node(number)
        below = [stream(number * 256 + int(k)) if number * 256 + int(k) in children else [(number, int(k), i) for i in range(int(n))] for k, n in zip(kids, plan.lengths)]
        return [below[s][i] for s, i in simulate([int(n) for n in plan.lengths], plan.quanta, plan.begin, 4)]

    order = stream(packing.ROOT)
    spans = [(*leaf[s], a, min(n - a, 37)) for s, n in lengths.items() for a in range(0, n, 37)]
    of, start, n, seq, offset = tree.pieces(*(np.array(x, np.int64) for x in zip(*spans)))
    plan = tree.node(packing.ROOT)[0]
    base = {i: i * 64 for i in range(plan.full)} | {plan.full + i: int(t) for i, t in enumerate(plan.tail[:-1])}
    got = {}
    for o, a, k, q, f in zip(of, start, n, seq, offset):
        node, child, b, _ = spans[o]
        for i in range(k):
            got[base[q] + f + i] = (node, child, b + a + i)
    assert len(got) == len(order) == sum(lengths.values()) and [got[i] for i in range(len(order))] == order


def test_ids_are_never_shuffled(spark):
    rows = [(i, "some words here", f"s{i % 7}", "x") for i in range(50)]
    plan = pack(spark.createDataFrame(rows, SCHEMA), PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan

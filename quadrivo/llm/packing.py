"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. A round gives every queue a quantum in proportion to
its target share, one window in all; a queue serves the whole units that its deficit counter holds and carries the
rest on to later rounds, whatever partition works on them. Queue s has thus served
A_s(k) = min(T_s, U * floor((k * q_s + d_s) / (U * 2**16))) tokens before round k, where q_s is its quantum in
2**-16 tokens, U the unit, T_s its length and d_s the deficit it begins with: less than a unit, and staggered, so that many small queues
don't all serve a unit in the same round. All of the state is in that closed form, so every task can place its
own documents: the token at place t of queue s is served in the round k with A_s(k) <= t < A_s(k+1), at

    sum over queues j < s of A_j(k+1)  +  sum over queues j >= s of A_j(k)  +  t - A_s(k).

The stream so ordered is cut at every window; what is left at its end is cut into powers of two, so no
sequence needs padding. An exhausted queue is skipped and the rest share the windows as before.

Any number of sources has queues of its own. Where they are many, the round-robin is nested: a node of a tree has some hundred queues at most, each of them
a source or the stream of a node below, so a token's place follows from the nodes on its way up. Nodes and the offsets of
tasks are tables in the shared folder, from which a task reads what concerns its own documents.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_bpe
from .shared import arrow_map, batch_of, column_type, drop_path, new_path, stored_rows, written

WINDOW, UNIT, SCALE = 2048, 32, 16
#: Sources of a tree with one node, and expected ones of a node in a larger tree; tasks whose offsets share a file, files of nodes.
ONE_NODE, OF_NODE, TOGETHER, NODE_FILES = 200, 64, 64, 256


class Schedule:
    """Where each token of each queue goes. lengths: tokens of each queue; weights: target shares (default: the lengths)."""

    def __init__(self, lengths: list[int], weights: list[float] | None = None, window: int = WINDOW, unit: int = UNIT):
        self.window, self.unit, self.lengths = window, unit, np.array(lengths, np.int64)
        w = [float(x) for x in (lengths if weights is None else weights)]
        total = sum(w) or 1.0
        self.quanta = np.array([max(1, round(window * x / total * (1 << SCALE))) for x in w], np.int64)
        every = np.arange(len(self.lengths))
        #: The deficits at the beginning: multiples of the golden section, which lie evenly however many they are.
        self.begin = every * 40503 % (1 << SCALE) * unit
        #: The round before which each queue is exhausted.
        self.ended = self.round_of(every, np.maximum(self.lengths - 1, 0) // unit) + 1
        self.total = int(self.lengths.sum())
        self.full, rest = divmod(self.total, window)
        #: Ends of the sequences after the full windows: the set bits of the rest, largest first.
        self.tail = np.cumsum([0, *(1 << b for b in range(window.bit_length(), -1, -1) if rest >> b & 1)]) + self.full * window

    def served(self, queue, rounds):
        """A: the tokens that a queue has served before a round."""
        rounds = np.minimum(rounds, self.ended[queue])  # later ones serve nothing, and would not fit into 64 bits
        return np.minimum(self.lengths[queue], self.unit * ((rounds * self.quanta[queue] + self.begin[queue]) // (self.unit << SCALE)))

    def round_of(self, queue, unit):
        """The round that serves the n-th unit of a queue."""
        q = self.quanta[queue]
        return -((self.begin[queue] - (unit + 1) * (self.unit << SCALE)) // q) - 1

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """For intervals of queues: interval, start in it, length, sequence, offset there; one row for each piece."""
        return self.cut(*self.spread(queue, start, length))

    def spread(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """For intervals of queues: interval, start in it, length, place in the stream; one row for each run of tokens."""
        u = self.unit
        first, last = start // u, (start + length - 1) // u
        count = np.where(length > 0, last - first + 1, 0)
        of = np.repeat(np.arange(len(queue)), count)
        if not len(of):
            return (np.empty(0, np.int64),) * 4
        unit = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
        k = self.round_of(queue[of], unit)
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (k[1:] != k[:-1])])
        lo_unit, hi_unit, of, k = unit[new], unit[np.r_[new[1:], len(unit)] - 1] + 1, of[new], k[new]
        lo, hi = np.maximum(lo_unit * u, start[of]), np.minimum(hi_unit * u, (start + length)[of])
        own = queue[of]
        place = lo - self.served(own, k)
        for j in range(len(self.lengths)):
            place += self.served(np.full(1, j), k + (own > j))
        return of, lo - start[of], hi - lo, place

    def cut(self, of, lo, n, place):
        """Cuts runs where a sequence ends."""
        w, ends = self.window, place + n
        head, tail = place // w, (ends - 1) // w
        count = tail - head + 1
        at = np.repeat(np.arange(len(of)), count)
        seq = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + head[at]
        a, b = np.maximum(seq * w, place[at]), np.minimum((seq + 1) * w, ends[at])
        base = seq * w
        out = [[at[m := seq < self.full], a[m], b[m], seq[m], base[m]]]
        m = seq >= self.full
        for i, (s, e) in enumerate(zip(self.tail[:-1], self.tail[1:])):
            x, y = np.maximum(a[m], s), np.minimum(b[m], e)
            ok = x < y
            out.append([at[m][ok], x[ok], y[ok], np.full(ok.sum(), self.full + i), np.full(ok.sum(), s)])
        at, a, b, seq, base = (np.concatenate(c) for c in zip(*out))
        return of[at], lo[at] + a - place[at], b - a, seq, a - base


ROOT = 1


def _tree(totals: DataFrame, weights: dict | None) -> tuple[DataFrame, DataFrame]:
    """source, node, child: where each source's queue is; and node, children (child, tokens, weight). A node's number is its parent's with a byte behind it."""
    spark = totals.sparkSession
    sources = totals.groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights is None:
        sources = sources.withColumn("weight", F.col("tokens").cast("double"))
    else:
        given = spark.createDataFrame([(None if s is None else str(s), float(w)) for s, w in weights.items()], "s string, weight double")
        sources = sources.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sources = written(sources, "sources")
    n, levels = sources.count(), 0
    while n > (ONE_NODE if not levels else OF_NODE * 256**levels):
        levels += 1
    node = F.lit(ROOT).cast("long")
    for level in range(levels):
        node = node * 256 + F.shiftrightunsigned(F.xxhash64("source", F.col("source").isNull()), 8 * level).bitwiseAND(F.lit(255).cast("long"))
    leaves = sources.withColumn("node", node).withColumn("child", (F.row_number().over(Window.partitionBy("node").orderBy(F.asc_nulls_first("source"))) - 1).cast("long"))
    leaves = written(leaves, "leaves")
    queues = leaves.select("node", "child", "tokens", "weight")
    every = queues
    for _ in range(levels):
        queues = queues.groupBy("node").agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight")).select(F.shiftright("node", 8).alias("node"), F.col("node").bitwiseAND(F.lit(255).cast("long")).alias("child"), "tokens", "weight")
        every = every.unionByName(queues)
    return leaves.select("source", "node", "child"), every.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("child", "tokens", "weight"))).alias("children"))


class Tree:
    """The nested schedule, whose nodes are read when they are needed."""

    def __init__(self, path: str, window: int, unit: int):
        self.node = lru_cache(maxsize=64)(self._node)
        self.path, self.window, self.unit = path, window, unit

    def _node(self, number: int) -> tuple[Schedule, np.ndarray]:
        rows = stored_rows(self.path, number % NODE_FILES, ["children"], "node", number).column("children").to_pylist()[0]
        return Schedule([r["tokens"] for r in rows], [r["weight"] for r in rows], self.window, self.unit), np.array([r["child"] for r in rows])

    def pieces(self, node: np.ndarray, child: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """For intervals of the queues of nodes: interval, start in it, length, sequence, offset there."""
        of, lo = np.arange(len(node)), np.zeros(len(node), np.int64)
        while (node > ROOT).any():  # up from the deepest nodes, all of one depth
            made = []
            for number in np.unique(node):
                at = np.flatnonzero(node == number)
                plan, children = self.node(int(number))
                o, a, n, place = plan.spread(np.searchsorted(children, child[at]), start[at], length[at])
                made.append((of[at[o]], lo[at[o]] + a, np.full(len(o), number >> 8), np.full(len(o), number & 255), place, n))
            of, lo, node, child, start, length = (np.concatenate(c) for c in zip(*made))
        plan, children = self.node(ROOT)
        o, a, n, seq, offset = plan.pieces(np.searchsorted(children, child), start, length)
        return of[o], lo[o] + a, n, seq, offset


def pack(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", source: str = "source", weights: dict | None = None, window: int = WINDOW, unit: int = UNIT, end_id: int = 1) -> DataFrame:
    """One row for each piece of a document: key, start, length, ids_crc32 (of the ids as little-endian unsigned
    32-bit numbers), doc_tokens (with end_id), sequence_id, offset, queue (the source as text), ids (binary, little-endian, 2 or 4 bytes each).

    weights: target share of tokens by source (default: each source's own share); a source without one gets 0, so what else is there comes first.
    A null text counts as empty, so is packed as end_id alone; a null source is a source; a null or repeated key is carried along, its rows being documents
    of their own; an empty table gives no rows; other columns are not read.

    Texts are encoded once and kept, with each document's place among its task's documents of the source, so
    that only lengths are summed up afterwards; each task then looks its offsets up. Texts and ids are never shuffled.
    """
    bpe = byte_bpe(tokenizer)
    dtype, spark = bpe.dtype.str, df.sparkSession
    kind = column_type(df, key)
    encoded = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", kind), T.StructField("ids", T.BinaryType())])

    def encode(batches):
        bpe, task, so_far = byte_bpe(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([end_id], bpe.dtype)
        for b in batches:
            ats, ns, ids, sources = [], [], [], b.column(2).to_pylist()
            for t, s in zip(b.column(1).to_pylist(), sources):
                made = np.concatenate([bpe.ids(t), end])
                ats.append(so_far.get(s, 0)), ns.append(len(made)), ids.append(made.tobytes())
                so_far[s] = ats[-1] + len(made)
            yield batch_of([[task] * len(ids), sources, ats, ns, b.column(0), ids], encoded)

    kept = written(arrow_map(df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).cast("string").alias("source")), encode, encoded), "encoded")
    paths = {name: new_path(spark, name) for name in ("totals", "offsets", "nodes")}
    totals = written(kept.groupBy("source", "task").agg(F.sum("n").alias("n")), "totals", paths["totals"])
    leaves, nodes = _tree(totals, weights)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    offsets = totals.select("source", "task", before).withColumnRenamed("source", "s").join(leaves, F.col("s").eqNullSafe(F.col("source"))).select("source", "task", "base", "node", "child", F.floor(F.col("task") / TOGETHER).cast("int").alias("part"))
    offsets.repartition("part").write.partitionBy("part").parquet(paths["offsets"])
    nodes.withColumn("part", (F.col("node") % NODE_FILES).cast("int")).repartition("part").write.partitionBy("part").parquet(paths["nodes"])
    drop_path(spark, paths["totals"])
    out = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("queue", T.StringType()), T.StructField("ids", T.BinaryType())])

    def cut(batches):
        tree, size = Tree(paths["nodes"], window, unit), np.dtype(dtype).itemsize

        @lru_cache(maxsize=4)
        def begins(task: int) -> dict:
            rows = stored_rows(paths["offsets"], task // TOGETHER, ["source", "base", "node", "child"], "task", task)
            return {s: x for s, *x in zip(*(rows.column(c).to_pylist() for c in ("source", "base", "node", "child")))}

        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                queue = [begins(t)[s] for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                base, node, child = (np.array(c, np.int64) for c in zip(*queue))
                at, n = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                raw = b.column(5).to_pylist()
                of, start, length, seq, offset = tree.pieces(node, child, base + at, n)
                order = np.lexsort((start, of))
                of, start, length, seq, offset = (x[order] for x in (of, start, length, seq, offset))
                wide = [memoryview(np.frombuffer(r, dtype).astype("<u4").tobytes()) for r in raw]
                places = list(zip(of.tolist(), start.tolist(), (start + length).tolist()))
                crc = [zlib.crc32(wide[i][4 * s : 4 * e]) for i, s, e in places]
                ids = [raw[i][size * s : size * e] for i, s, e in places]
                yield batch_of([b.column(4).take(pa.array(of)), start, length, crc, n[of], seq, offset, b.column(1).take(pa.array(of)), ids], out)

    return arrow_map(kept.select("task", "source", "at", "n", "key", "ids"), cut, out)

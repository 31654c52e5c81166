"""Near duplicates by 64-bit SimHash fingerprints and vantage-point trees over Hamming distance.

Fingerprints that differ in at most `distance` bits are linked. Split into distance // 2 + 1 blocks of bits, two of them
differ in one bit at most in some block, so each block is searched as a metric space of its own with
radius 1 and every link is found. The upper levels of a block's vantage-point tree are the same for all: a fingerprint's distances
from a few vantage points name its shard. By the triangle bound a partner at block distance 0 has the
same distances, and one at block distance 1 has each of them one more or one less (parity excludes equal ones); which of them go up
depends on the one bit that differs. So a fingerprint visits, beside its own shard, one shard over the boundary for each bit of the block at most, and half of
these, as each pair is met from one side - however deep the tree. Within a shard the
tree goes on, with vantage points of its own, until few enough are left to compare whole fingerprints exactly.

Copies with one fingerprint are one point. A shard that holds more than SHARD points is dealt out as a grid of smaller ones, so no task gets them all.
Each shard returns a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import arrow_map, batch_of, column_type, ship, written

DISTANCE, SHINGLE, SEED = 4, 4, 42
#: Points of a shard that one task takes; points of a leaf's two sides that are compared at once; sample for vantage points.
SHARD, LEAF, SAMPLE = 1 << 16, 1 << 18, 256
_BITS = 1 << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits that are set in over half of the shingles' XXH64; 0 without words."""
    words = text.encode().lower().split() if text else []  # bytes: lowers A-Z only, splits at the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist())
    digest = xxhash.xxh64_intdigest
    return bits_of(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, n))


def bits_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BITS[2 * counts > len(hashes)].sum())


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """key, fp (the fingerprint as a signed long) for each row; a null text counts as empty."""
    schema = T.StructType([T.StructField(key, column_type(df, key)), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            made = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield batch_of([b.column(0), made.view(np.int64)], schema)

    return arrow_map(df.select(key, text), run, schema)


# --- within a shard ---------------------------------------------------------------------------------


class Forest:
    """Connected components of points 0..n-1 that grow by arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _compare(fps: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int, forest: Forest) -> None:
    step = max(1, LEAF // max(1, len(b)))
    for i in range(0, len(a), step):
        part = a[i : i + step]
        x, y = np.nonzero(np.bitwise_count(fps[part, None] ^ fps[None, b]) <= distance)
        apart = forest.root[part[x]] != forest.root[b[y]]
        if apart.any():
            forest.link(part[x[apart]], b[y[apart]])


def _rings(values: np.ndarray, members: np.ndarray, vantage: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Members in order of their distance from the vantage point, and where each distance 0..65 begins."""
    d = np.bitwise_count(values[members] ^ vantage)
    order = np.argsort(d, kind="stable")
    return members[order], np.searchsorted(d[order], np.arange(67))


def search(fps: np.ndarray, mask: np.uint64, homes: np.ndarray, others: np.ndarray, distance: int, forest: Forest) -> None:
    """Links homes with others within the distance: a vantage-point tree over the masked bits with radius 1, then over all bits with radius `distance`."""
    spaces = [(fps & mask, 1 if distance else 0), (fps, distance)]
    todo = [(homes, others, 0, 0)]
    while todo:
        a, b, space, failed = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= LEAF or space == len(spaces):
            _compare(fps, a, b, distance, forest)
            continue
        values, radius = spaces[space]
        vantage = values[a[(len(a) // 2 + 7919 * failed) % len(a)]]
        sa, ea = _rings(values, a, vantage)
        sb, eb = _rings(values, b, vantage)
        parts = []
        for d in np.flatnonzero(np.diff(ea)):
            lo, hi = eb[max(0, d - radius)], eb[min(66, d + radius + 1)]
            if hi > lo:
                parts.append((sa[ea[d] : ea[d + 1]], sb[lo:hi]))
        work = sum(len(x) * len(y) for x, y in parts)
        if work > 0.8 * len(a) * len(b):  # this vantage point prunes too little: another one, then the next space
            todo.append((a, b, space + (failed >= 2), failed + 1 if failed < 2 else 0))
        else:
            todo += [(x, y, space, 0) for x, y in parts]


# --- over all shards --------------------------------------------------------------------------------


def _blocks(distance: int) -> list[int]:
    """Masks that split the 64 bits into distance // 2 + 1 blocks."""
    n = distance // 2 + 1
    ends = [64 * i // n for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _vantage_points(sample: list[int], mask: int, n: int) -> list[int]:
    """Points of the sample from which distances spread most and are alike least."""
    values = np.array(sample, np.int64).view(np.uint64) & np.uint64(mask)
    d = np.bitwise_count(values[:, None] ^ values[None, :]).astype(float)
    picked: list[int] = []
    if not len(values):
        return picked
    d -= d.mean(1, keepdims=True)
    for _ in range(min(n, len(values))):
        best = int(np.argmax((d**2).sum(1)))
        picked.append(int(values[best]))
        unit = d[best] / (np.sqrt((d[best] ** 2).sum()) or 1)
        d = d - np.outer(d @ unit, unit)
    return picked


def plan(n: int, distance: int = DISTANCE, shard: int = SHARD) -> tuple[int, float]:
    """Vantage points of each block's tree for n different fingerprints, and how often each fingerprint is expected to be sent if they are spread evenly.

    A vantage point leaves a sixth at most in the largest shard, which its guests then enlarge; a third is left for uneven data. The depth ends
    where shards are single values of a block, or their numbers no longer fit into 62 bits.
    """
    masks = _blocks(distance)
    width = max(m.bit_count() for m in masks)
    most = next(k for k in range(64, 0, -1) if len(masks) * (width + 2) ** k < 1 << 62 and (k == 1 or 6 ** (k - 4) < 2**width))
    guests = lambda k: min(2 ** (k - 1), width / 2) if distance else 0
    depth = next((k for k in range(1, most) if n * (1 + guests(k)) / 6**k <= shard / 1.5), most)
    largest = n * (1 + guests(depth)) / min(6**depth, 2**width)
    return depth, len(masks) * (1 + guests(depth)) * max(1, -(-largest // shard))


def visits(points: DataFrame, sample: list[int], distance: int, depth: int) -> DataFrame:
    """fp, shard, guest: each fingerprint (column fp) at home in a shard of each block, and as a guest in those over the boundary."""
    masks, found = _blocks(distance), []
    base = max(m.bit_count() for m in masks) + 2
    for block, mask in enumerate(masks):
        vantage = _vantage_points(sample, mask, depth)
        powers = [base ** (len(vantage) - 1 - i) for i in range(len(vantage))]
        code = F.lit(block * base**depth)
        for v, power in zip(vantage, powers):
            code = code + F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(v)))).cast("long") * F.lit(power)
        shards = F.array(F.struct(code.cast("long").alias("shard"), F.lit(False).alias("guest")))
        if distance and vantage:
            # What a bit's change from 0 to 1 adds to the code; from 1 to 0 it takes that off.
            bits = [j for j in range(64) if mask >> j & 1]
            change = F.array(*(F.struct(F.lit(j).alias("bit"), F.lit(sum(-p if v >> j & 1 else p for v, p in zip(vantage, powers))).cast("long").alias("by")) for j in bits))
            moved = F.transform(change, lambda c: F.when(F.getbit("fp", c["bit"]) == 1, -c["by"]).otherwise(c["by"]))
            over = F.array_distinct(F.filter(moved, lambda d: d > 0))
            shards = F.concat(shards, F.transform(over, lambda d: F.struct((code + d).cast("long").alias("shard"), F.lit(True).alias("guest"))))
        found.append(shards)
    return points.select("fp", F.explode(F.concat(*found)).alias("v")).select("fp", "v.shard", "v.guest")


def links(points: DataFrame, distance: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """Spanning links (a, b) of all pairs of distinct fingerprints (column fp) within the distance; each shard's links are a forest."""
    ship(points.sparkSession)
    sample = [r.fp for r in points.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    depth, _ = plan(points.count(), distance, shard)
    met = visits(points, sample, distance, depth)
    # A shard without a home point has no work; one with too many points becomes a grid.
    sizes = written(met.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(~F.col("guest")).alias("homes")).filter("homes > 0 and n > 1"), "shards")
    dealt = sizes.select("shard", F.ceil(F.col("n") / shard).cast("int").alias("side"))
    dealt = F.broadcast(dealt) if sizes.count() <= 200_000 else dealt
    salt = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("side")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("side") - 1), lambda j: F.struct(F.least(F.col("salt"), j).alias("i"), F.greatest(F.col("salt"), j).alias("j")))
    spread = met.join(dealt, "shard").withColumn("salt", salt).select("fp", "guest", "salt", "shard", F.explode(cells).alias("c")).select("fp", "guest", "salt", "shard", "c.i", "c.j")
    masks = _blocks(distance)
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    blocks_of = (max(m.bit_count() for m in masks) + 2) ** depth

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        code, i, j = (k.as_py() for k in key)
        fps = group.column("fp").to_numpy().view(np.uint64)
        guest, salt = group.column("guest").to_numpy(), group.column("salt").to_numpy()
        forest, mask = Forest(len(fps)), np.uint64(masks[code // blocks_of])
        if i == j:
            homes = np.flatnonzero(~guest)
            search(fps, mask, homes, np.arange(len(fps)), distance, forest)
        else:
            for x, y in ((i, j), (j, i)):
                search(fps, mask, np.flatnonzero(~guest & (salt == x)), np.flatnonzero((salt == y) & (guest | (x == i))), distance, forest)
        own = np.flatnonzero(forest.root != np.arange(len(fps)))
        signed = fps.view(np.int64)
        return pa.table({"a": signed[own], "b": signed[forest.root[own]]})

    return spread.groupBy("shard", "i", "j").applyInArrow(run, out)


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE, shingle: int = SHINGLE, shard: int = SHARD) -> DataFrame:
    """For each row: key, fingerprint (16 lowercase hex digits), component_id (the smallest key it is linked with over any number of links, its own included).

    Words are runs of characters other than the six ASCII spaces, A-Z lower-cased; shingles are `shingle` words, repeats included; a
    shorter text is one shingle. A null, empty or blank text has fingerprint zero, which is linked like any other. Repeated rows
    and keys repeat; a null key is never the smallest unless it is alone; an empty table gives none.
    """
    made = written(fingerprints(df, text, key, shingle), "fingerprints")
    points = written(made.groupBy("fp").agg(F.min(key).alias("least")), "points")
    found = written(links(points, distance, shard).distinct(), "links")
    roots = components(found)
    groups = written(points.join(roots, points.fp == roots.node, "left").select("fp", "root", "least"), "groups")
    # A component may hold a third of all fingerprints: its least key is written first, so that this is a plain join, whose large partitions can be split.
    linked = groups.filter("root IS NOT NULL")
    tops = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "tops")
    labels = linked.join(tops, "root").select("fp", "component_id").union(groups.filter("root IS NULL").select("fp", "least"))
    return made.join(labels, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Near copies of texts: links of Jaccard similarity LEAST / OF or more over sets of word shingles, every one found and none else.

Shingles are compared by their XXH64. Texts with equal sets are one point. Links are sought in four steps, each of which leaves less to the next:

1. SimHash: the sets' fingerprints go through the vantage-point trees of simhash; its links, and equal fingerprints, are compared whole.
2. Pivots: two sets that are alike enough share a shingle among the first n - ceil(0.8 n) + 1 of each, whatever the order of all shingles
   (prefix filter). While groups of points that share one are so large that their pairs would outgrow them, each group's points are compared with one of them, and
   what is linked need not be compared again. So a group of many copies costs a few comparisons for each copy, not one for each pair.
3. Rarest first: where groups are still crowded, by points that share a passage and are not alike, all points of such groups are filtered by prefixes again, now in
   the order of exact document frequencies among them, so that a shared passage comes last in each; and each has an odd sketch, in which the bits that two
   sets don't share are no more than the shingles that they don't share, so that most pairs that can't be alike are never made.
4. The rest: points of a group that are not connected yet are paired at the first shingle that they share, not once for each: where both have a shared one among the few
   before, they have met already. What comes before the first is in one set only, which bounds what they can share at all; pairs within the bound are held against odd sketches
   as long as the sets, and those that are left are compared whole. So no link between points that are not connected otherwise is lost.

In steps 2 and 4 shingles that are frequent in a sample come last in the order; the sample bears on the work only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import arrow_map, batch_of, column_type, drop_path, new_path, written
from .simhash import bits_of, links

LEAST, OF, SHINGLE, SEED = 4, 5, 5, 42
#: Documents in which frequent shingles are sought, in how many of them one is frequent, and the most that are kept.
SAMPLE, FREQUENT, MOST = 10_000, 4, 200_000
#: Unconnected points of a group beyond which its points are compared with a pivot first, and the most rounds of that (each has to halve the pairs that are left in such groups).
CROWDED, ROUNDS = 32, 3
#: Pairs of a group up to which they are made without looking at sketches, and a sketch's 64-bit words.
HEAVY, WORDS = 256, 16
#: Shingles of a point that are looked at for an earlier meeting.
BEFORE = 4


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of the text's shingles, words as in simhash; a shorter text is one shingle, one without words the shingle 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(1, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[len(words) - n :].tolist())), np.uint64, n))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return OF * shared >= LEAST * (len(a) + len(b) - shared)


def _exploded(texts: DataFrame) -> DataFrame:
    """id, s: each shingle of each text (columns id, text) once."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.LongType())])

    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = shingles(t).view(np.int64)
                yield batch_of([np.full(len(found), i), found], schema)

    return arrow_map(texts.select("id", "text"), run, schema)


def _frequent(df: DataFrame, text: str) -> np.ndarray:
    """Shingles that are in FREQUENT or more of about SAMPLE rows, drawn by a hash of the text and the place."""
    share = min(1.0, SAMPLE / max(1, df.count()))
    drawn = df.filter(F.pmod(F.xxhash64(text, F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = _exploded(drawn.select(F.lit(0).cast("long").alias("id"), F.col(text).alias("text"))).groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    return np.sort(np.array([r.s for r in found.orderBy(F.desc("n"), "s").limit(MOST).collect()], np.int64).view(np.uint64))


def odd_sketch(s: np.ndarray, words: int = WORDS) -> np.ndarray:
    """64-bit words, a power of two of them: each shingle turns one bit over. Two sets' sketches differ in as many bits at most as shingles are in one set only."""
    odd = np.bincount((s >> np.uint64(64 - 6) << np.uint64(words.bit_length() - 1) | s & np.uint64(words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(s: np.ndarray) -> bytes:
    """An odd sketch of WORDS words or more, and of two bits for a shingle or more."""
    return odd_sketch(s, max(WORDS, 1 << (-(-len(s) // 32) - 1).bit_length())).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two wide sketches differ, the longer one folded to the other's length."""
    a, b = (np.frombuffer(z, np.uint8).reshape(64, -1) for z in (x, y))
    width = min(a.shape[1], b.shape[1])
    a, b = (np.bitwise_xor.reduce(z.reshape(64, -1, width), axis=1) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _near_sketches(x: str, y: str, n: str, m: str) -> str:
    """Whether sets with these sketches and sizes can be alike: those in one only are (OF - LEAST) / (OF + LEAST) of all at most."""
    apart = " + ".join(f"bit_count({x}{i} ^ {y}{i})" for i in range(WORDS))
    return f"{OF + LEAST} * ({apart}) <= {OF - LEAST} * ({n} + {m})"


def _first(n: int) -> int:
    """How many shingles of a set of n are its prefix."""
    return n - -(-LEAST * n // OF) + 1


def _sets(df: DataFrame, text: str, key: str, frequent: np.ndarray) -> DataFrame:
    """key, text, id (a hash of the set), n (its size), fp (its fingerprint), prefix (the shingles by which it is found), sketch."""
    schema = T.StructType([T.StructField("key", column_type(df, key)), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("id", "n", "fp")), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                ids, sizes, fps, prefixes, sketches = [], [], [], [], []
                for t in b.column(1).to_pylist():
                    s = shingles(t)
                    ids.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                    sizes.append(len(s))
                    fps.append(bits_of(s))
                    sketches.append(odd_sketch(s).byteswap().tobytes())
                    if len(frequent):
                        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                        s = np.r_[s[~late], s[late]]
                    prefixes.append(s[: _first(len(s))].view(np.int64).tolist())
                yield batch_of([b.column(0), b.column(1), np.array(ids, np.uint64).view(np.int64), sizes, np.array(fps, np.uint64).view(np.int64), prefixes, sketches], schema)

    return arrow_map(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run, schema).withColumn("row", F.monotonically_increasing_id())


def _rarest_first(texts: DataFrame, points: DataFrame) -> DataFrame:
    """p and pos (its place in the prefix) with the points' columns (id, n, root, ...): the points by the shingles of their prefixes, in the order of how many of these points have a shingle; of shingles that two of them share at least."""
    held = written(_exploded(texts.join(points.select("id"), "id", "left_semi")), "shingles")
    often = held.groupBy("s").agg(F.count("*").alias("m"))
    rows = held.join(often, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("m", "s"))).alias("all"))  # a text's shingles, so as many as a row may hold
    size = F.size("all")
    prefix = F.slice("all", F.lit(1), (size - F.ceil(size * LEAST / OF) + 1).cast("int"))
    some = rows.select("id", F.posexplode(prefix).alias("pos", "x")).filter("x.m > 1").select("id", F.col("x.s").alias("p"), "pos")
    return some.join(points, "id").select("p", "pos", *points.columns)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        held: dict[int, str | None] = {}

        @lru_cache(maxsize=256)
        def set_of(i: int) -> np.ndarray:
            return shingles(held[i])

        for batch in batches:
            a, b, s, t = (batch.column(i).to_pylist() for i in range(4))
            held = dict(zip(a + b, s + t))
            kept = [i for i in range(len(a)) if alike(set_of(a[i]), set_of(b[i]))]
            yield batch_of([[a[i] for i in kept], [b[i] for i in kept]], schema)

    whole = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a")
    return arrow_map(whole.select("a", "b", "s", "t"), run, schema)


def _within(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be alike by their wide sketches: of both sets' shingles (OF - LEAST) / (OF + LEAST) at most are in one only."""
    ends = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("wide", T.BinaryType())])
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def sketches(batches):
        for batch in batches:
            found = [(len(s), wide_sketch(s)) for s in map(shingles, batch.column(1).to_pylist())]
            yield batch_of([batch.column(0), [n for n, _ in found], [w for _, w in found]], ends)

    def run(batches):
        for batch in batches:
            a, b, both, x, y = (batch.column(i).to_pylist() for i in range(5))
            kept = [i for i in range(len(a)) if (OF + LEAST) * apart(x[i], y[i]) <= (OF - LEAST) * both[i]]
            yield batch_of([[a[i] for i in kept], [b[i] for i in kept]], schema)

    made = written(arrow_map(texts.select("id", "text"), sketches, ends), "wide")
    of = lambda c, n, w: made.select(F.col("id").alias(c), F.col("n").alias(n), F.col("wide").alias(w))
    return arrow_map(pairs.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").select("a", "b", (F.col("n") + F.col("m")).alias("both"), "x", "y"), run, schema)


def _fit(n: str, m: str) -> str:
    """Whether sets of these sizes can be alike."""
    return f"{OF} * least({n}, {m}) >= {LEAST} * greatest({n}, {m})"


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _hooked(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root after more links: each label goes over to the least one that a link leads to, once. Equal labels are connected, but what is connected may have several labels:
    that is enough to leave out comparisons, and costs a few stages where the components would cost some dozens."""
    ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if labels is None:
        return written(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    of = lambda c, to: labels.select(F.col("node").alias(c), F.col("root").alias(to))
    named = ends.join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left").select("a", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    named = written(named.union(labels.select("node", "root", "root")).groupBy("a", "ra").agg(F.min("rb").alias("rb")), "named")
    goes = named.groupBy("ra").agg(F.min("rb").alias("to"))
    return written(named.join(goes, "ra").select(F.col("a").alias("node"), F.least("ra", "to").alias("root")), "labels")


def _preceded(rest: DataFrame) -> DataFrame:
    """rest with before: the BEFORE shingles by which a point is there that come before p in its prefix."""
    return rest.withColumn("before", F.collect_list("p").over(Window.partitionBy("id").orderBy("pos").rowsBetween(-BEFORE, -1)))


def _met(rest: DataFrame, sketch: Sequence[str] = ()) -> DataFrame:
    """a, b: pairs of points (p, pos, before, id, n, root, main, and the words of a sketch) that are in a group and not connected, where p may be the first shingle that they share: neither has one
    of those before it in common, and what is left of each set from there suffices. Of the main part's points none are paired with each other; other points that meet from both sides count on one."""
    side = lambda df, x, *more: df.select("p", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "pos", "root", "before", *sketch)), *more)
    a, b = side(rest.filter("root <> main"), "x"), side(rest, "y", "main")
    fit = f"x_root <> y_root AND (y_root = main OR x_id < y_id) AND {_fit('x_n', 'y_n')}"
    fit += f" AND {OF + LEAST} * least(x_n - x_pos, y_n - y_pos) >= {LEAST} * (x_n + y_n)" + (f" AND {_near_sketches('x_k', 'y_k', 'x_n', 'y_n')}" if sketch else "")
    same_p = a.alias("l").join(b.alias("r"), (F.col("l.p") == F.col("r.p")) & F.expr(f"{fit} AND NOT arrays_overlap(x_before, y_before)"))
    return same_p.select(*_ordered(F.col("x_id"), F.col("y_id")))


def near_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: key, component_id (the smallest key it is linked with over any number of links, its own included).

    Null, empty and blank texts are alike. Rows are told apart by their place, so repeated rows and keys are rows of their own, which repeat; a null key is never the smallest
    unless all of its group are null; an empty table gives none; other columns are not read.
    """
    spark = df.sparkSession
    sets_path = new_path(spark, "sets")
    made = written(_sets(df, text, key, _frequent(df, text)), "", sets_path)
    # A row for each set, which is told by its number from then on, so that no key is needed, be it null or repeated.
    points = written(made.groupBy("id").agg(F.min("key").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")), "", points_path := new_path(spark, "points"))
    # Only shingles that two points share can link any.
    every = points.select("id", "n", F.posexplode("prefix").alias("pos", "p"))
    common = every.groupBy("p").agg(F.count("*").alias("m")).filter("m > 1").select("p")
    group_path = new_path(spark, "groups-of-shingles")
    groups = written(every.join(common, "p"), "", group_path)
    # SimHash: trees over distinct fingerprints, each of which its smallest point stands for.
    prints = written(points.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("m")), "prints")
    near = links(prints.select("fp")).distinct()
    first = lambda c, to: prints.select(F.col("fp").alias(c), F.col("first").alias(to))
    same = points.select("id", "fp").join(prints.filter("m > 1"), "fp").filter("id <> first").select(*_ordered(F.col("id"), F.col("first")))
    found = written(near.join(first("a", "x"), "a").join(first("b", "y"), "b").select(*_ordered(F.col("x"), F.col("y"))).union(same).distinct(), "near")
    # Texts of all points that may have to be compared.
    ends = found.select(F.explode(F.array("a", "b")).alias("id")).union(groups.select("id")).distinct()
    text_path = new_path(spark, "texts")
    texts = written(made.select("row", "text").join(points.select("id", "row").join(ends, "id"), "row").select("id", "text"), "", text_path)
    # Texts and prefixes lie in these tables only from here on.
    made, points = written(made.select("key", "id"), "keys"), written(points.select("id", "least", "n", "sketch"), "points")
    for path in (sets_path, points_path):
        drop_path(spark, path)
    linked = [written(_verified(found, texts), "links")]
    labels = _hooked(_hooked(None, linked[0]), linked[0])
    before = float("inf")
    for step in range(ROUNDS + 1):
        at = written(groups.join(labels, groups.id == labels.node, "left").select("p", "pos", "id", "n", F.coalesce("root", "id").alias("root")), "", at_path := new_path(spark, "placed"))
        # The points of a group that are connected with most of it need no comparison among themselves.
        parts = at.groupBy("p", "root").agg(F.count("*").alias("m"))
        main = written(parts.groupBy("p").agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("top")).select("p", "m", F.col("top.root").alias("main"), (F.col("m") - F.col("top.m")).alias("others")).filter("others > 0"), "main")
        many = F.col("m").cast("double") * F.col("others")
        size = main.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("points"), F.coalesce(F.sum(many), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum(F.when(F.col("others") > CROWDED, many)), F.lit(0.0)).alias("hot")).first()
        if step == ROUNDS or not size.hot or size.hot > before / 2:
            break
        before = size.hot
        here = at.join(main.filter(f"others > {CROWDED}").select("p"), "p")
        pivot = here.groupBy("p").agg(F.min(F.struct(F.xxhash64(F.lit(step), "id"), F.col("id").alias("v"), F.col("n").alias("nv"), F.col("root").alias("rv"))).alias("x")).select("p", "x.v", "x.nv", "x.rv")
        pairs = written(here.join(pivot, "p").filter(f"root <> rv AND {_fit('n', 'nv')}").select(*_ordered(F.col("id"), F.col("v"))).distinct(), "pivots")
        linked.append(written(_verified(pairs, texts), "links"))
        labels = _hooked(_hooked(labels, linked[-1]), linked[-1])  # the pivot goes over to the least label around it, then the others follow
        drop_path(spark, at_path)
    rest, met, words = at.join(main.select("p", "main"), "p"), None, [f"k{i}" for i in range(WORDS)]
    sketched = points.select("id", *(F.conv(F.hex(F.substring("sketch", 8 * i + 1, 8)), 16, -10).cast("long").alias(w) for i, w in enumerate(words)))
    if size.pairs > CROWDED * size.points:
        crowded = main.filter(f"others > {CROWDED}").select("p")
        points_there = written(at.join(crowded, "p").select("id", "n", "root").distinct().join(sketched, "id"), "crowded")
        again = written(_rarest_first(texts, points_there), "rarest")
        parts = again.groupBy("p", "root").agg(F.count("*").alias("m"))
        tops = parts.groupBy("p").agg(F.count("*").alias("roots"), F.max(F.struct("m", "root")).alias("top")).filter("roots > 1").select("p", F.col("top.root").alias("main"))
        rest, met = rest.join(crowded, "p", "left_anti"), _met(_preceded(again.join(tops, "p")), words)
    # What two points share in a crowded group counts as met, as such points are found by their new prefixes. Groups of few pairs need no sketch; the others' pairs,
    # which grow with the square of a group's size, are held against theirs before they are made.
    rest = written(_preceded(rest), "rest")
    for path in (at_path, group_path):
        drop_path(spark, path)
    heavy = main.filter(f"m * others > {HEAVY}").select("p")
    for part in (_met(rest.join(heavy, "p", "left_anti")), _met(rest.join(heavy, "p").join(sketched, "id"), words)):
        met = part if met is None else met.union(part)
    pairs = written(_within(met.distinct(), texts), "pairs")
    # What the labels connect already is one node.
    named = lambda c, to: labels.select(F.col("node").alias(c), F.col("root").alias(to))
    every_link = reduce(DataFrame.union, [*linked, _verified(pairs, texts)])
    between = every_link.join(named("a", "ra"), "a", "left").join(named("b", "rb"), "b", "left").select(*_ordered(F.coalesce("ra", "a"), F.coalesce("rb", "b"))).filter("a <> b").distinct()
    roots = components(written(between, "links"))
    drop_path(spark, text_path)
    placed = points.select("id", "least").join(labels, points.id == labels.node, "left").select("id", "least", F.coalesce("root", "id").alias("label"))
    placed = written(placed.join(roots, placed.label == roots.node, "left").select("id", "least", F.coalesce("root", "label").alias("root")), "groups")
    tops = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "tops")
    return made.select(F.col("key").alias(key), "id").join(placed.join(tops, "root").select("id", "component_id"), "id").select(key, "component_id")

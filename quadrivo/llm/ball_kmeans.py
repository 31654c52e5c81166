"""Centroid clustering by ball k-means, exact in whole numbers.

A cluster is a ball around its centroid, which holds all its members. Balls whose centroids are further apart than twice a ball's radius have nothing to take from it, so
each cluster has a short list of neighbours, by distance. Members nearer to their centroid than half the way to the nearest neighbour are its stable core and stay
without any comparison; half the ways to the next ones part the others into annuli, of which the m-th is compared with the m nearest neighbours.

Vectors are packed once into blocks of whole numbers and kept. A round reads the blocks and writes, for each, one byte a vector and sums by cluster; which cluster a vector
was in is read by the task from the round before. Only centroids, counts and radii (k of each) come to the driver and go out again.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, batch_of, column_type, drop_path, new_path, stored_rows

#: Vectors of a block; where whole numbers are cut off, so that squared distances of 64 of them are exact in doubles.
ROWS, MOST = 4096, 1 << 20


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), within MOST either way."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * float(scale)), -MOST, MOST).astype(np.int32)


def _packed(df: DataFrame, size: int, scale: int, kind: T.DataType) -> DataFrame:
    """part (the task), block, keys, data (int32 by row)."""
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("data", T.BinaryType())])

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                piece = b.slice(lo, ROWS)
                values = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield batch_of([[part], [n], [piece.column(0).to_pylist()], [whole(values, scale).tobytes()]], schema)
                n += 1

    return arrow_map(df, run, schema)


def _seeds(df: DataFrame, k: int, seed: int, size: int, scale: int) -> np.ndarray:
    """The vectors of the k smallest hashes of seed and key; equal hashes (of equal keys) by their numbers."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    first = df.select(name.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return whole(np.array([r.vector for r in first], np.float64).reshape(-1, size), scale).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to c, exact below 2**53."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Balls:
    """Centroids, with an upper bound of each ball's squared radius (None: no members are known yet)."""

    def __init__(self, centroids: np.ndarray, radii: list[int] | None):
        self.c = centroids.astype(np.float64)
        n = range(len(centroids))
        apart = [[int(((centroids[i] - centroids[j]) ** 2).sum()) for j in n] for i in n]
        self.near: list[tuple[np.ndarray, np.ndarray]] = []  # neighbours by distance, and their squared distances
        if radii is None:
            return
        for i in n:
            # x is within r of i; a centroid further from i than 2r is further from x than r
            order = sorted((apart[i][j], j) for j in n if j != i and apart[i][j] <= 4 * radii[i])
            self.near.append((np.array([j for _, j in order], int), np.array([d for d, _ in order], np.float64)))

    def assign(self, x: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row (ties: the smaller number) and the squared distance."""
        if before is None:
            d = np.stack([squared(x, c) for c in self.c], 1)
            at = d.argmin(1)
            return at, d[np.arange(len(x)), at]
        cluster, distance = before.astype(int), np.empty(len(x))
        for i, (near, apart) in enumerate(self.near):
            members = np.flatnonzero(before == i)
            if not len(members):
                continue
            own = squared(x[members], self.c[i])
            best, to = own.copy(), np.full(len(members), i)
            annulus = np.searchsorted(apart, 4 * own, side="right")  # how many neighbours may be as near
            for m in range(annulus.max(initial=0)):
                some = np.flatnonzero(annulus > m)
                d = squared(x[members[some]], self.c[near[m]])
                better = (d < best[some]) | (d == best[some]) & (near[m] < to[some])
                best[some[better]], to[some[better]] = d[better], near[m]
            cluster[members], distance[members] = to, best
        return cluster, distance


def _round(blocks: DataFrame, balls: Balls, before: str | None, size: int, path: str) -> None:
    """Writes by part: block, cluster (a byte or two for each vector), and for each cluster its vectors' sums, count and greatest squared distance."""
    k = len(balls.c)
    dtype = "<u1" if k <= 256 else "<u2"
    member = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("far", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("clusters", T.BinaryType()), T.StructField("members", T.ArrayType(member))])

    def run(batches):
        for b in batches:
            for part, block, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                x = np.frombuffer(data, np.int32).reshape(-1, size).astype(np.float64)
                cluster, distance = balls.assign(x, _before(before, part, block, dtype))
                made = []
                for i in np.unique(cluster).tolist():
                    at = cluster == i
                    made.append({"cluster": i, "n": int(at.sum()), "far": int(distance[at].max()), "sums": x[at].sum(0).astype(np.int64).tolist()})
                yield batch_of([[part], [block], [cluster.astype(dtype).tobytes()], [made]], schema)

    arrow_map(blocks.select("part", "block", "data"), run, schema).write.partitionBy("part").parquet(path)


def _before(path: str | None, part: int, block: int, dtype: str) -> np.ndarray | None:
    if path is None:
        return None
    return np.frombuffer(stored_rows(path, part, ["clusters"], "block", block).column("clusters")[0].as_py(), dtype)


def _moved(rounds: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Each centroid as the floor of its vectors' mean, and a bound of its ball's squared radius around there."""
    member = rounds.select(F.explode("members").alias("m")).select("m.*")
    total = member.select("cluster", "n", "far", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("far").alias("far"))
    moved, radii = centroids.copy(), [0] * len(centroids)
    for r in total.collect():  # k times the components
        moved[r.cluster, r.i] = r.s // r.n
        radii[r.cluster] = r.far
    for i, c in enumerate(moved):
        radii[i] = (isqrt(radii[i]) + 1 + isqrt(int(((c - centroids[i]) ** 2).sum())) + 1) ** 2
    return moved, radii


def ball_kmeans(df: DataFrame, vector: str = "embedding", key: str = "vec_id", size: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """For each kept vector: key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of the final centroid's numbers as decimals, joined by commas).

    Kept are vectors of exactly `size` numbers, none null or not finite; they count as floor(scale * x). Centroids start as the k vectors of the smallest sha256 of "seed:key" (fewer vectors:
    as many; a null key hashes as an empty one; equal keys go by their numbers). Ties go to the smaller number; a centroid without vectors stays. Repeated
    rows are vectors of their own; no kept vector gives no rows; other columns are not read. Numbers beyond 2**20 either way are taken as that, and a sum of distances beyond a long is null.
    """
    spark, kind = df.sparkSession, column_type(df, key)
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where((F.size("vector") == size) & ~broken)
    path = new_path(spark, "blocks")
    _packed(rows, size, scale, kind).write.option("compression", "zstd").partitionBy("part").parquet(path)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("data", T.BinaryType()), T.StructField("part", T.IntegerType())])
    blocks = spark.read.schema(schema).parquet(path)
    centroids = _seeds(rows, k, seed, size, scale)
    radii, before = None, None
    for _ in range(rounds):
        now = new_path(spark, "round")
        if not len(centroids):
            break
        _round(blocks, Balls(centroids, radii), before, size, now)
        centroids, radii = _moved(spark.read.parquet(now), centroids)
        if before:
            drop_path(spark, before)
        before = now
    return _final(blocks, centroids, radii, before, size, key, kind)


def _final(blocks: DataFrame, centroids: np.ndarray, radii: list[int] | None, before: str | None, size: int, key: str, kind: T.DataType) -> DataFrame:
    """The last assignment, by vector, with the sums over clusters."""
    spark, balls = blocks.sparkSession, Balls(centroids, radii)
    dtype = "<u1" if len(centroids) <= 256 else "<u2"
    schema = T.StructType([T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                part, block, data = (b.column(c)[i].as_py() for c in range(3))
                x = np.frombuffer(data, np.int32).reshape(-1, size).astype(np.float64)
                cluster, distance = balls.assign(x, _before(before, part, block, dtype))
                yield batch_of([b.column(3).slice(i, 1).flatten(), cluster, distance.astype(np.int64)], schema)

    path = new_path(spark, "assigned")
    arrow_map(blocks.select("part", "block", "data", "keys"), run, schema).write.parquet(path)
    assigned = spark.read.schema(schema).parquet(path)
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    in_long, total = lambda n: n if n < 1 << 63 else None, sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sums = spark.createDataFrame([(i, in_long(n), in_long(total), names[i]) for i, n in inertia.items()], "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(sums), F.col("cluster") == F.col("of")).select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int = 10) -> str:
    apart = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < 8)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT k.r, min(struct_pack(d := {apart}, c := c.c)) AS m FROM kept k CROSS JOIN c{i} c GROUP BY k.r)")
        if i < rounds:
            parts.append(f"u{i} AS (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i} JOIN kept USING (r))")
            parts.append(f"s{i} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM u{i} GROUP BY c, i)")
            parts.append(f"n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN n{i} n ON n.c = c.c)")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c ON c.c = m.c"
    )


#: The same rounds by comparing every vector with every centroid.
CLUSTERS_SQL = _rounds_sql()

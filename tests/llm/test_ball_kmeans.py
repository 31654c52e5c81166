import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from quadrivo.llm import queries
from quadrivo.llm.ball_kmeans import MOST, Balls, ball_kmeans, squared
from quadrivo.llm.shared import table

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType())])


def brute(rows, size, k=8, rounds=10):
    kept = [(key, [int(np.floor(np.float64(x) * 1024)) for x in v]) for key, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c, x = [v for _, v in first], np.array([v for _, v in kept], np.int64).reshape(-1, size)

    def nearest():
        d = np.array([((x - np.array(v)) ** 2).sum(1) for v in c]).reshape(len(c), len(x))
        return d.argmin(0) if len(c) else np.zeros(0, int), d

    for _ in range(rounds):
        at, _ = nearest()
        c = [[int(s) // int((at == i).sum()) for s in x[at == i].sum(0)] if (at == i).any() else v for i, v in enumerate(c)]
    at, d = nearest()
    d = d[at, np.arange(len(x))]
    names = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((key, int(i), int(e), int(d[at == i].sum()), int(d.sum()), names[i]) for (key, _), i, e in zip(kept, at, d)), key=str)


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_balls_assign_as_all_comparisons_do(seed):
    rng = np.random.default_rng(seed)
    c = rng.integers(-30, 30, (20, 3))
    x = rng.integers(-40, 40, (3000, 3)).astype(float)
    before = rng.integers(0, 20, 3000)
    radii = [int(squared(x[before == i], c[i]).max(initial=0)) for i in range(20)]
    d = np.stack([squared(x, v) for v in c], 1)
    cluster, distance = Balls(c, radii).assign(x, before)
    assert cluster.tolist() == d.argmin(1).tolist() and distance.tolist() == d.min(1).tolist()


def test_balls_spare_comparisons():
    rng = np.random.default_rng(1)
    c = np.array([[1000 * i, 0] for i in range(10)])
    before = rng.integers(0, 10, 1000)
    x = c[before] + rng.integers(-100, 100, (1000, 2)).astype(float)
    balls = Balls(c, [20_000] * 10)
    assert all(len(near) == 0 for near, _ in balls.near)
    assert balls.assign(x, before)[0].tolist() == before.tolist()
    wide = Balls(c, [300_000] * 10)
    assert sorted(len(near) for near, _ in wide.near) == [1, 1, *[2] * 8]


def rows_of(n, size, groups, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, size))
    return [(i, (centre[rng.integers(groups)] + 0.3 * rng.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]


def test_against_brute_force(spark):
    rows = rows_of(9000, 5, 6)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    assert ordered(ball_kmeans(df, size=5)) == brute(rows, 5)
    assert ordered(ball_kmeans(df, size=5, k=20, rounds=4)) == brute(rows, 5, 20, 4)


def test_rows_that_are_hard(spark):
    rows = rows_of(60, 4, 3)
    rows += [(100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 2.0, 3.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    rows += [(7, [0.0] * 4)] * 50 + [(8, [0.0] * 4)] * 30  # repeats, ties
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert ordered(ball_kmeans(df, size=4)) == brute(rows, 4)
    few = [(1, [0.25, -0.25, 0.0, 1.0]), (2, [0.25, -0.25, 0.0, 1.0])]
    assert ordered(ball_kmeans(spark.createDataFrame([(*r, "") for r in few], SCHEMA), size=4)) == brute(few, 4)
    assert ordered(ball_kmeans(spark.createDataFrame([(1, None, "")], SCHEMA), size=4)) == []
    assert ball_kmeans(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_huge_numbers_are_cut_off(spark):
    rows = [(i, [3e38, -3e38] * 32) for i in range(3)] + [(9, [0.0] * 64)]
    got = ball_kmeans(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), k=1, rounds=1).collect()
    assert len(got) == 4 and max(r.distance for r in got) <= 64 * MOST**2


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert ordered(queries.QUERIES["op13_ball_kmeans"](spark, sf)) == brute(rows, 64)

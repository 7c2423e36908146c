"""Clusters against plain integer arithmetic, and the threshold algorithm against all distances."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

from depotlane.llm import centroids


def brute(vectors, start, rounds):
    near = lambda v, cs: min(range(len(cs)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, cs[c])), c))
    cs = [list(vectors[i]) for i in start]
    for _ in range(rounds):
        groups = {}
        for v in vectors:
            groups.setdefault(near(v, cs), []).append(v)
        for c, vs in groups.items():
            cs[c] = [sum(x) // len(vs) for x in zip(*vs)]
    return [near(v, cs) for v in vectors], cs


def test_threshold_equals_all_distances():
    rng = np.random.default_rng(3)
    skipped = 0
    for spread, size, k in ((3, 2, 5), (1000, 8, 40), (2, 64, 8), (10**8, 4, 30)):
        cs = rng.integers(-spread, spread, (k, size))
        cs[k // 2] = cs[0]  # equal centroids: the smaller number counts
        vectors = np.concatenate([rng.integers(-spread, spread, (500, size)), cs])
        which, best, computed = centroids.nearest(vectors, cs)
        table = ((vectors[:, None, :] - cs[None]) ** 2).sum(axis=2)
        assert (which == table.argmin(axis=1)).all() and (best == table.min(axis=1)).all() and computed.max() <= k
        skipped += int((computed < k).sum())
    assert skipped > 500  # distances that were never computed


def made(rows, size, rng):
    near = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    return [[x + rng.gauss(0, 0.2) for x in rng.choice(near)] for _ in range(rows)]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, v) for i, v in enumerate(made(300, 6, rng))] + [(7, [0.5] * 6), (7, [0.5] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    out, final = centroids.cluster(df, size=6, rounds=4)
    whole = [[math.floor(1024 * x) for x in v] for _, v in rows]
    start = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), whole[i]))[:8]
    which, cs = brute(whole, start, 4)
    assert final == cs
    distance = [sum((a - b) ** 2 for a, b in zip(v, cs[c])) for v, c in zip(whole, which)]
    inertia = [sum(d for d, c in zip(distance, which) if c == k) for k in range(8)]
    want = sorted((i, c, d, inertia[c], sum(distance)) for (i, _), c, d in zip(rows, which, distance))
    assert sorted(map(tuple, out.collect())) == want


def test_cases(spark):
    bad = [None, [], [1.0] * 3, [1.0] * 5, [None] * 4, [1.0, 2.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(bad)] + [(None, [1.0, -0.5, 0.0, 2.0]), (9, [1.0, -0.5, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, final = centroids.cluster(df, size=4)
    assert {tuple(r) for r in out.collect()} == {(None, 0, 0, 0, 0), (9, 0, 0, 0, 0)} and final == [[1024, -512, 0, 2048]] * 2
    out, final = centroids.cluster(df.where("vec_id < 7"), size=4)
    assert out.count() == 0 and final == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>"), size=4)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_sql(spark):
    got = centroids.op13_centroids(spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.sql(centroids.oracle())
    assert sorted(got.select(*want.columns).toPandas().itertuples(index=False, name=None)) == sorted(want.fetchall())

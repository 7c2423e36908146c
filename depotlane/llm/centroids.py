"""Clusters of vectors around centroids; nearest centroids by the threshold algorithm.

Every dimension has a list of the centroids sorted by their value there. For a vector, each list is walked
outward from the vector's own value, one centroid at a step; a centroid that any list reaches
first has its whole distance computed once. The squared gaps at the lists' frontiers sum to a
lower bound for every centroid not yet reached, so a vector is settled as soon as that sum
strictly exceeds its best distance (at equality a centroid of a smaller number might still tie).

Vectors are integers, so sums, floors and distances are exact, whatever the order of rows. A
round is one pass over the vectors: tasks add up their own clusters, and only k times d sums
reach the driver, which holds the k centroids. Vectors are written once to the checkpoint folder.

Cases: vectors that are null, of another length, or with a null or non-finite component are
left out; a null key is an ordinary row; repeated rows count each; with fewer vectors than
clusters every vector starts one; of equally near centroids the smaller number is taken; an
empty table gives an empty table; other columns are not read. A component of LIMIT or more after
scaling fails, because distances would not be exact in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depotlane.llm.tables import cut, read

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Components are below it, so that a distance over 64 dimensions stays below 2^62.
LIMIT = 2**27
#: Vectors that a task looks at together.
BLOCK = 2048
FAR = np.iinfo(np.int64).max


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, squared distance, distances computed) for each row of integers, by the threshold algorithm."""
    count, size = vectors.shape
    k, dims = len(centroids), np.arange(size)
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, axis=0)
    right = np.stack([np.searchsorted(lists[:, d], vectors[:, d]) for d in dims], axis=1)
    left = right - 1
    best, which, computed = np.full(count, FAR), np.full(count, k), np.zeros(count, np.int64)
    seen, live = np.zeros((count, k), bool), np.arange(count)
    while len(live):
        x, lower, upper = vectors[live], left[live], right[live]
        below = np.where(lower >= 0, x - lists[np.maximum(lower, 0), dims], FAR)
        above = np.where(upper < k, lists[np.minimum(upper, k - 1), dims] - x, FAR)
        down = below <= above
        reached = np.zeros((len(live), k), bool)
        reached[np.arange(len(live))[:, None], order[np.where(down, lower, upper), dims]] = True
        reached &= ~seen[live]
        row, number = np.nonzero(reached)
        table = np.full((len(live), k), FAR)
        gaps = x[row] - centroids[number]
        table[row, number] = np.einsum("ij,ij->i", gaps, gaps)
        first = table.argmin(axis=1)
        found = table[np.arange(len(live)), first]
        better = (found < best[live]) | ((found == best[live]) & (first < which[live]))
        best[live[better]], which[live[better]] = found[better], first[better]
        computed[live] += reached.sum(axis=1)
        seen[live] |= reached
        edge = np.minimum(below, above)
        settled = (np.einsum("ij,ij->i", edge, edge) > best[live]) | seen[live].all(axis=1)
        left[live], right[live] = lower - down, upper + ~down
        live = live[~settled]
    return which, best, computed


def whole(vector: Column, size: int, scale: int) -> Column:
    """floor(scale * x) of every component as integers; null for a vector that isn't kept."""
    number = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) != float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(number(x) * scale))
    fits = F.forall(scaled, lambda x: x.between(1 - LIMIT, LIMIT - 1))
    return F.when((F.size(vector) == size) & finite, F.when(fits, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))))


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch of (key, vector), with the vectors as 64-bit integers."""
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        yield part, part.column(1).flatten().to_numpy().reshape(-1, size).astype(np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of every cluster that has vectors: one pass, k times d rows to the driver."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, block in _blocks(batch, size):
                which = nearest(block, centroids)[0]
                np.add.at(sums, which, block)
                counts += np.bincount(which, minlength=k)
        cluster, place = np.divmod(np.arange(k * size), size)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cluster, place, sums.ravel(), counts[cluster])], ["cluster", "place", "total", "n"])

    parts = vectors.mapInArrow(run, "cluster long, place long, total long, n long")
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r.cluster, r.place)):
        if r.n:
            found.setdefault(r.cluster, (r.n, []))[1].append(int(r.total))
    return found


def _assign(vectors: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    """(key, cluster, distance) of each vector."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in _blocks(batch, size):
                which, best, _ = nearest(block, centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(which.astype(np.int32)), pa.array(best)], ["key", "cluster", "distance"])

    return vectors.mapInArrow(run, f"key {vectors.schema['key'].dataType.simpleString()}, cluster int, distance long")


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    size: int = DIMENSIONS, scale: int = SCALE, seed: int = 3,
) -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster, distance, cluster_inertia, inertia) of each kept vector, final centroids)."""
    scaled = df.select(df[key].alias("key"), whole(df[vector], size, scale).alias("v")).where("v is not null")
    vectors = cut(scaled)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    start = vectors.orderBy(mark, "v").limit(clusters).select("v").collect()
    empty = f"key {scaled.schema['key'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long"
    if not start:
        return df.sparkSession.createDataFrame([], empty).withColumnRenamed("key", key), []
    centroids = np.array([r.v for r in start], np.int64)
    for _ in range(rounds):
        moved = centroids.copy()
        for number, (n, totals) in _sums(vectors, centroids).items():
            moved[number] = [t // n for t in totals]  # floors, of negative sums too
        if np.array_equal(moved, centroids):
            break  # further rounds would repeat this one
        centroids = moved
    assigned = cut(_assign(vectors, centroids, key))
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of_cluster = F.create_map(*[F.lit(x) for pair in inertia.items() for x in pair])
    out = assigned.select(
        F.col("key").alias(key), "cluster", "distance", of_cluster[F.col("cluster")].cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia")
    )
    return out, centroids.tolist()


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centroids = cluster(read(spark, sf_dir, "embeddings"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return out.withColumn("centroid_sha256", F.element_at(F.array(*map(F.lit, names)).cast("array<string>"), F.col("cluster") + 1))


def oracle(rounds: int = ROUNDS, clusters: int = CLUSTERS) -> str:
    """SQL with one step for every round. Floors are quotients of what is left after the remainder."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
parts AS MATERIALIZED (SELECT r, unnest(range(1, {DIMENSIONS + 1})) AS d, unnest(v) AS x FROM kept),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c FROM kept QUALIFY c < {clusters}),
c0 AS MATERIALIZED (SELECT c, d, x FROM first JOIN parts USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, arg_min(c, CAST(distance AS HUGEINT) * {clusters} + c) AS c, min(distance) AS distance FROM
  (SELECT r, c, CAST(sum((p.x - q.x) * (p.x - q.x)) AS BIGINT) AS distance FROM parts p JOIN c{i} q USING (d) GROUP BY r, c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT c, d, CAST({floor} AS BIGINT) AS x FROM (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{i} JOIN parts USING (r) GROUP BY c, d)),
c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c, d))""")
    last = rounds
    return "WITH " + ",".join(steps) + f""",
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{last} JOIN kept USING (r) JOIN named USING (c)"""


QUERIES, ORACLES = {"op13_centroids": op13_centroids}, {"op13_centroids": oracle()}

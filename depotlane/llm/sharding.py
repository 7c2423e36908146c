"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups are sorted by size, largest
first, and each goes to the least-loaded shard through a heap. The heap runs on the driver
over classes of equal group size, not over groups: groups of one size are interchangeable,
so a class of n groups is n equal jobs. Sizes keep `PRECISION` leading bits, which bounds
the number of classes (2048 for each of at most 52 powers of two, about 100,000 rows of a
few numbers) for any input and moves a load by less than one part in 4000.

Cases: a null text has no bytes and groups with the empty text; a null key is an ordinary
row; repeated rows are rows of one group and each take a slot; an empty table gives an empty
table; other input columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from depotlane.llm.tables import cut, read, text_of

SHARDS = 8
PRECISION = 12
#: Rows that one window of the ranking sorts, on average.
ROWS_PER_WINDOW = 50_000


def size_class(size: Column) -> Column:
    """The size with its `PRECISION` leading bits kept."""
    bits = F.length(F.bin(size))
    step = F.greatest(F.lit(0), bits - PRECISION)
    return F.call_function("shiftleft", F.call_function("shiftright", size, step), step)


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For (class, groups, total size), largest class first: (class, bounds), where shard k takes the groups with ranks below bounds[k].

    Jobs of one class are equal, so after the heap has brought all shards within one job
    of each other, whole rounds give each shard one more job and are counted at once.
    """
    heap = [(0.0, k) for k in range(shards)]
    plan = []
    for size, groups, total in sorted(classes, reverse=True):
        job, counts, left = total / groups, [0] * shards, groups
        while left:
            low, high = heap[0][0], max(heap)[0]
            if high - low < job and left >= shards:
                rounds = left // shards
                heap = [(load + rounds * job, k) for load, k in heap]  # the order stays
                counts = [c + rounds for c in counts]
                left -= rounds * shards
            elif high - low >= job and left > shards:  # all jobs that fit below the others
                load, k = heapq.heappop(heap)
                many = max(1, min(left, int((heap[0][0] - load) // job)))
                heapq.heappush(heap, (load + many * job, k))
                counts[k] += many
                left -= many
            else:
                load, k = heapq.heappop(heap)
                heapq.heappush(heap, (load + job, k))
                counts[k] += 1
                left -= 1
        bounds, at = [], 0
        for c in counts:
            at += c
            bounds.append(at)
        plan.append((size, bounds))
    return plan


def ranked(df: DataFrame, by: list[str], order: list[Column], total: int, rank: str) -> DataFrame:
    """`df` with a gapless rank from 0 among rows with equal `by`; ties fall by `order`.

    A value of `by` may hold most rows, so each is split into parts by hash. A window ranks
    within a part, and the part's offset is the number of rows in earlier parts.
    """
    parts = max(1, -(-total // ROWS_PER_WINDOW))
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = df.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    out = df.withColumn("_own", own).join(offsets, [*by, "_part"])
    return out.withColumn(rank, F.col("_offset") + F.col("_own")).drop("_part", "_own", "_offset")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """`key`, size (UTF-8 bytes and 1), text_crc32, shard and slot of each row."""
    body = text_of(text)
    rows = df.select(
        df[key].alias("key"), (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("same"),
    )
    rows = cut(rows)  # a few numbers a row: the texts are read once
    groups = rows.groupBy("same").agg(F.sum("size").alias("total"))
    groups = groups.withColumn("class", size_class(F.col("total")))
    histogram = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("total").alias("total"))
    classes = [tuple(r) for r in histogram.collect()]  # bounded by PRECISION
    plan = df.sparkSession.createDataFrame(schedule(classes, shards), "class long, bounds array<long>")
    n_groups = sum(n for _, n, _ in classes)
    dealt = ranked(groups, ["class"], [F.col("same")], n_groups, "rank").join(F.broadcast(plan), "class")
    dealt = dealt.select("same", F.size(F.filter("bounds", lambda b: b <= F.col("rank"))).alias("shard"))
    placed = rows.join(dealt, "same")
    n_rows = rows.count()
    order = [F.col("key"), F.col("text_crc32"), F.col("size"), F.col("same")]
    placed = ranked(placed, ["shard"], order, n_rows, "slot")
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES, ORACLES = {"op3_sharding": op3_sharding}, {}

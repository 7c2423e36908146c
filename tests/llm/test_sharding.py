"""Longest-processing-time shards: balance, groups together, gapless slots."""

import heapq
import random
import zlib
from collections import defaultdict

from depotlane.llm import sharding as s


def plain(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    for x in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + x, k))
    return sorted(load for load, _ in heap)


def test_schedule_is_lpt():
    rng = random.Random(5)
    for n in (0, 1, 7, 50, 4000):
        sizes = [rng.choice([1, 2, 3, 50, 51, 900, 20000 // (1 + n % 7)]) for _ in range(n)]
        classes = [(x, sizes.count(x), x * sizes.count(x)) for x in set(sizes)]
        loads = [0] * 8
        for x, bounds in s.schedule(classes, 8):
            for k in range(8):
                loads[k] += x * (bounds[k] - (bounds[k - 1] if k else 0))
        assert sorted(loads) == plain(sizes, 8)


def test_shard(spark):
    rng = random.Random(1)
    texts = [None, "", "é" * 10] + ["w" * rng.randint(1, 3000) for _ in range(300)] + ["copy" * 20] * 60
    rows = [(i if i != 9 else None, t, "x") for i, t in enumerate(texts)] + [(50, texts[50], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = s.shard(df).collect()
    assert len(got) == len(rows)
    loads, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in where.values())
    assert set(loads) <= set(range(8)) and max(loads.values()) - min(loads.values()) < 120
    want = sorted(len((t or "").encode()) + 1 for _, t, _ in rows)
    assert sorted(r["size"] for r in got) == want
    assert zlib.crc32("é".encode() * 10) in {r.text_crc32 for r in got}
    assert s.shard(df.limit(0)).count() == 0

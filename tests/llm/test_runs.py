"""Periodic runs against all lags by brute force."""

import hashlib
import os
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from depotlane.llm import runs


def brute(words):
    n, found = len(words), []
    for q in range(1, n // runs.TURNS + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            if length >= max(runs.LEAST, runs.TURNS * q) and not any(all(a == b for a, b in zip(stretch, stretch[p:])) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(rng):
    """Words with runs of many periods, nested ones and near misses among them."""
    words = []
    for _ in range(rng.randint(0, 6)):
        block = [rng.choice("abcdefghijkl"[: rng.choice([1, 2, 3, 12])]) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 12, 13, 18, 27, 40, 61]))]
        if rng.random() < 0.3:
            block = block * rng.randint(2, 5) + [rng.choice("xyz")]
        size = int(len(block) * rng.choice([1, 2, 3.9, 4, 4.3, 6]))
        words += [block[i % len(block)] for i in range(size)]
        if words and rng.random() < 0.4:
            words[rng.randrange(len(words))] = "!"
    return [w.encode() for w in words]


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    texts = [made(rng) for _ in range(60)]
    assert runs.runs(runs.numbered(texts)) == [brute(t) for t in texts]


def test_binary_words_and_long_periods():
    rng = random.Random(5)
    texts = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 300))] for _ in range(40)]
    for period in (97, 250, 1000):
        block = [str(rng.random()).encode() for _ in range(period)]
        texts.append([b"x"] + (block * 5)[: 4 * period + period // 2] + [b"y"])
        texts.append((block * 4)[: 4 * period - 1])
    got = runs.runs(runs.numbered(texts))
    assert got[:40] == [brute(t) for t in texts[:40]]
    assert got[40:] == [[(1, 4 * p + p // 2, p)] if k == 0 else [] for p in (97, 250, 1000) for k in (0, 1)]


def test_scales_hold_every_period():
    for q in range(runs.SHORT + 1, 3000):
        (width,) = [w for low, w in runs.scales(3000) if low < q <= w]
        assert 2 * width - 1 + q <= runs.TURNS * q


def test_one_word_all_along_is_linear():
    words = np.zeros(300_000, np.int64)
    assert runs.runs([words]) == [[(0, 300_000, 1)]]


def test_planted_edit():
    words = [str(i).encode() for i in range(500)]
    key = next(str(k) for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    g = zlib.crc32(key.encode()) // 10
    a = g % 500
    p = 1 + (500 - a) // (3 + g % 8)
    got = runs.planted(words, key)
    assert got == words[:a] + [words[a + (i - a) % p] for i in range(a, 500)]
    assert runs.planted(words, None) == words and runs.planted([], key) == []


def test_frame(spark):
    rows = [(1, "a b a b a b a b c", "x"), (1, "a b a b a b a b c", "y"), (2, None, "y"), (3, "", None), (None, "z " * 5000, "y"), (4, "k   k", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")
    got = {(*r[:6], tuple(map(tuple, r.runs)), r.collapsed) for r in runs.detect(df, outputs=names).collect()}
    assert got == {
        (1, 1, 0, 8, 2, 4000, ((0, 8, 2),), "a b c"), (2, 0, None, None, None, None, (), ""), (3, 0, None, None, None, None, (), ""),
        (None, 1, 0, 5000, 1, 5_000_000, ((0, 5000, 1),), "z"), (4, 0, None, None, None, None, (), "k   k"),
    }
    assert runs.detect(df, outputs=names).count() == 6
    assert runs.detect(df.limit(0)).count() == 0


def test_best_and_ties():
    assert runs.best([]) is None
    assert runs.best([(0, 8, 2), (3, 40, 10), (5, 9, 2)]) == (5, 9, 2)
    assert runs.best([(0, 8, 2), (3, 40, 10)]) == (0, 8, 2)
    assert runs.collapsed([b"a", b"b"] * 5, [(0, 10, 2)]) == b"a b"


def by_lag(words):
    """All runs of an array of word numbers: one comparison for each lag."""
    found = []
    for q in range(1, len(words) // runs.TURNS + 1):
        same = np.concatenate([[False], words[q:] == words[:-q], [False]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(same))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = end - start + q
            stretch = words[start : start + length]
            if length >= max(runs.LEAST, runs.TURNS * q) and not any(np.array_equal(stretch[p:], stretch[:-p]) for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_whole_table_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in runs.op12_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    found = 0
    for doc_id, text in docs:
        words = runs.planted((text or "").encode().split(), str(doc_id))
        want = by_lag(runs.numbered([words])[0])
        found += len(want)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in want)]
        r = got[doc_id]
        assert r.n_runs == len(want) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest(), doc_id
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
        if want:
            s, n, q = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
    assert found > 10

"""Fingerprints: edited texts, likeness against exact similarity, odd rows."""

import hashlib
import random

from pyspark.sql import functions as F

from depotlane.llm import fingerprints as f


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_edits_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(f, "BLOCK_ROWS", 7)
    rng = random.Random(6)
    texts = [" ".join(f"é{rng.randint(0, 9**6)}" for _ in range(rng.choice([1, 4, 6, 30, 100, 900, 3000]))) for _ in range(40)]
    rows = [(i * i * 3, t) for i, t in enumerate(texts)] + [(5, None), (7, ""), (8, texts[9])]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, block string")
    got = {r.doc_id: r for r in f.fingerprints(df).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    off = []
    for (k, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after, r = t or "", after or "", got[k]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == (256 if t.split() else 0)
        a, b = shingles(t), shingles(edited)
        off.append(abs(r.near_edited - len(a & b) / len(a | b)))
        assert r.near_next < 0.2 or not t
    assert max(off) < 0.17 and sum(off) / len(off) < 0.05
    assert got[8].fingerprint == got[243].fingerprint


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "x y z"), (4, "x y z"), (None, None)], "doc_id long, text string")
    assert f.fingerprints(df).count() == 4
    one = f.fingerprints(df.limit(1)).collect()
    assert one[0].near_next == 1.0
    assert f.fingerprints(df.limit(0)).count() == 0


def test_successors(spark, monkeypatch):
    """Against a sort of all rows: keys missing in most rows, equal keys, far outliers, keys that are strings, repeated rows."""
    monkeypatch.setattr(f, "BLOCK_ROWS", 3)
    rng = random.Random(8)
    keys = [None] * 60 + [7] * 30 + [rng.randint(0, 50) for _ in range(40)] + [2**62, -(2**62)]
    rows = [(k, rng.choice(["", "same text", f"own {i}"])) for i, k in enumerate(keys)]
    for kind, turn in (("long", lambda k: k), ("string", lambda k: None if k is None else f"k{k}é\"")):
        df = spark.createDataFrame([(turn(k), t) for k, t in rows], f"key {kind}, text string")
        marked = [tuple(r) for r in df.select("key", F.xxhash64("text"), "text").collect()]
        low = "" if kind == "string" else 0
        order = sorted(marked, key=lambda r: (r[0] is not None, low if r[0] is None else r[0], r[1], r[2]), reverse=True)
        want = sorted((str(a[0]), a[2], b[2]) for a, b in zip(order, order[1:] + order[:1]))
        got = f.with_next(df).select("key", "text", "next_text").collect()
        assert sorted((str(r.key), r.text, r.next_text) for r in got) == want

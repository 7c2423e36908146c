"""Substring dedup against all windows."""

import random

from depotlane.llm import substrings as s


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, []
    for k, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 19):
            seen.setdefault(tuple(w[i : i + 20]), (k, i))
    for k, t in rows:
        w = (t or "").encode().split()
        gone = {j for i in range(len(w) - 19) if seen[tuple(w[i : i + 20])] != (k, i) for j in range(i, i + 20)}
        out.append((str(k), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def rows():
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    passage, hot = words(60), words(25)
    out = []
    for i in range(150):
        w = words(rng.randint(0, 120))
        for part in (passage[rng.randint(0, 15) : rng.randint(40, 60)], ["a"] * rng.randint(1, 60), hot):
            if rng.random() < 0.5:
                w[rng.randint(0, len(w)) : 0] = part
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return list(enumerate(out + [out[3], out[4], None, "", "é " * 19, "é " * 21])) + [(None, out[5])]


def test_brute(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame([(k, t, 3) for k, t in data], "doc_id long, text string, start int")
    for bucket in (s.BUCKET, 2):
        monkeypatch.setattr(s, "BUCKET", bucket)
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in s.dedup(df).collect())
        assert got == brute(data)
    assert s.dedup(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, t), (1, t), (1, t + " x"), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in s.dedup(df).collect())
    assert [g for g in got if g[1] == 30 and g[0] == 2] == [(2, 30, 30)]
    assert sorted(g[2] for g in got if g[0] == 1) in ([0, 0, 30], [0, 30, 30])

"""Line dedup against all pairs of lines."""

import random

from pyspark.sql import functions as F

from depotlane.llm import lines as m


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s) + 1)
        s[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "é🙂"[rng.randint(0, 1)]])
    return "".join(s)


def test_near(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        a = "".join(rng.choices("ab", k=rng.randint(0, 12)))
        b = edit(rng, a, rng.randint(0, 4)) if a and rng.random() < 0.7 else "".join(rng.choices("ab", k=rng.randint(0, 12)))
        rows.append((*sorted((a, b), key=len, reverse=True),))
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    for k in (1, 2, 3):
        for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", m._near(chars("a"), chars("b"), k).alias("n")).collect():
            assert r.n == (distance(r.a, r.b) <= k), (r, k)
        for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", m.near(F.col("a"), F.col("b"), k).alias("n")).collect():
            assert r.n == (distance(r.a, r.b) <= k), (r, k)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, root = {}, {}
    for k, t in rows:
        for i, s in enumerate((t or "").split("\n")):
            if s.strip(" "):
                first.setdefault(s, (k, i))
    order = list(first)
    root = {s: s for s in order}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(order):
        for b in order[:i]:
            if min(len(a), len(b)) >= m.SHORTEST and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                x, y = sorted((find(a), find(b)), key=order.index)
                root[y] = x
    out = []
    for k, t in rows:
        own = (t or "").split("\n")
        kept = [s for i, s in enumerate(own) if not s.strip(" ") or first[find(s)] == (k, i)]
        out.append((str(k), len(own) if t is not None else 0, len(own) - len(kept), "\n".join(kept) if t is not None else None))
    return sorted(out)


def test_brute(spark):
    rng = random.Random(9)
    line = lambda: "".join(rng.choices("abcde ", k=rng.randint(20, 60)))
    base = [line() for _ in range(12)]
    rows = [(i, "\n".join(edit(rng, rng.choice(base), rng.randint(0, 3)) if rng.random() < 0.6 else line() for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[5][1]), (None, base[0]), (63, "\n\n")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, place string")
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept) for r in m.dedup(df).collect())
    assert got == brute(rows)
    assert m.dedup(df.limit(0)).count() == 0


def test_hot_segment(spark):
    """Several hundred lines of one template, most of them apart, with numbers and words that make some near."""
    rng = random.Random(5)
    words = "stone river lantern copper meadow winter harbour engine saddle ribbon".split()
    rows = []
    for i in range(160):
        place = [rng.choice(words) for _ in range(3)]
        number = rng.randint(0, 9999) if i % 3 else 7
        rows.append((i, f"the {place[0]} of number {number} stands between the {place[1]} and some other {place[2]} near the road"))
    rows += [(1000 + i, rows[i][1].replace("stands", rng.choice(["stand", "stands,", "stonds"]))) for i in range(0, 160, 9)]
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept) for r in m.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)

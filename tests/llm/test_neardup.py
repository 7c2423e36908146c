"""MinHash links and components against all pairs."""

import random

from depotlane.llm import components as cc, neardup as n
from depotlane.llm.shingles import shingle_set


def brute(rows):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((k, len(sets[k]), find(k), find(k) == k) for k in keys)


def test_brute(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 6, 60, 200, 500]))]
        for _ in range(rng.choice([1, 2, 5, 90 if g == 3 else 8])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9)}"
            rows.append("  ".join(own) if rng.random() < 0.8 else " ".join(own).upper())
    rows += [None, "", " \n", "One two", "one  TWO", "é é é é é", "É é é é é"]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 100))
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, node int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in n.link(df).collect())
    assert got == brute(rows)
    assert n.link(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in n.link(odd).collect()) == [("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True)]


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 130)) and {got[k] for k in (200, 201, 202)} == {200}


def test_sets():
    assert len(shingle_set("A b c d e A b c d e", 5)) == 5 and len(shingle_set("a\tb", 5)) == 1 and len(shingle_set("\x0b", 5)) == 0


def test_template_hides_links(spark):
    """Texts of one template, unlinked but for two with short parts of their own, which no bucket has as its least."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    template = [word() for _ in range(404)]
    short = {100, 1300}
    rows = [(k, " ".join(template + [word() for _ in range(35 if k in short else 46)])) for k in range(1500)]
    got = {r.doc_id: r.component_id for r in n.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: 100 if k in short else k for k in range(1500)}

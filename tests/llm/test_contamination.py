"""Wu-Manber search against plain search."""

import random

from depotlane.llm import contamination as c


def brute(text, items):
    own = c.words(text)
    hit, found = set(), set()
    for item, body in items:
        w = c.words(body)
        for p in [w[i : i + 13] for i in range(max(1, len(w) - 12))] if w else []:
            for i in range(len(own) - len(p) + 1):
                if own[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(own)


def case():
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "Été", "x1", "ZZ"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 13, 14, 20])))) for i in range(8)] + [(8, None), (9, ""), (10, "...")]
    items.append((11, items[7][1]))
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            body[rng.randint(0, len(body)) : 0] = rng.choice(items[:8])[1].split()
        docs.append((i, ", ".join(body)))
    return docs + [(60, None), (61, ""), (None, "a b")], items


def test_brute(spark):
    docs, items = case()
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(k), *brute(t, items)) for k, t in docs)
    for bounds in ({}, {"at_once": 9}, {"bytes_at_once": 300}):
        got = c.contamination(d, b, **bounds).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == want
    assert not any(r.contaminated for r in c.contamination(d, b.limit(0)).collect())
    assert c.contamination(d.limit(0), b).count() == 0

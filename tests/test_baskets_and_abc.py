"""Baskets, ABC limits and graph helpers against hand-made or brute-force results."""

import itertools
import math

from depotlane.operators import abc, basket, graph


def test_abc_limits(spark):
    df = spark.createDataFrame([("a", 80, 1.0), ("b", 15, 1.0), ("c", 5, 1.0)], "sku string, lines long, units double")
    assert {r.sku: r.abc_class for r in abc.abc_rank(df, ["sku"]).collect()} == {"a": "A", "b": "B", "c": "C"}
    none = spark.createDataFrame([("a", 0, 0.0)], "sku string, lines long, units double")
    assert abc.abc_rank(none, ["sku"]).first().abc_class == "D"
    assert abc.abc_rank(df.limit(0), ["sku"]).count() == 0


def test_pair_metrics(spark):
    rows = [("t1", "a", 2.0), ("t1", "b", 1.0), ("t2", "a", 1.0), ("t2", "b", 3.0), ("t3", "b", 1.0), ("t4", "c", 1.0)]
    items = spark.createDataFrame(rows, "transaction_id string, article string, quantity_sum double")
    r = basket.pair_metrics(items, 1).first()
    assert (r.article_a, r.article_b, r.shared_transactions, r.shared_quantity) == ("a", "b", 2, 2.0)
    assert r.confidence_a_b == 1.0 and r.conviction_a_b == math.inf and abs(r.lift - (2 / 4) / (2 / 4 * 3 / 4)) < 1e-12
    assert r.joint_support <= min(r.support_a, r.support_b)


def modularity(edges, groups):
    total = sum(w for *_, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    inside = sum(w for a, b, w in edges if groups[a] == groups[b]) / total
    return inside - sum((sum(d for n, d in degree.items() if groups[n] == g) / (2 * total)) ** 2 for g in set(groups.values()))


def test_graph_helpers():
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 0.1), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0)]
    groups = graph.communities(edges, sum(w for *_, w in edges))
    assert groups["a"] == groups["b"] == groups["c"] != groups["d"] == groups["e"] == groups["f"]
    assert modularity(edges, groups) > modularity(edges, {n: n for n in "abcdef"})
    path = graph.betweenness([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])
    assert path == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}
    square = graph.betweenness([(a, b, 1.0) for a, b in itertools.pairwise("abcda")])
    assert all(abs(v - 0.5) < 1e-12 for v in square.values())


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")], "article_a string, article_b string")
    assert {r.article: r.component for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}

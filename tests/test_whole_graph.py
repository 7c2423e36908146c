"""Item graphs of any size: no edge is dropped, and paths settled in parts are those of the whole."""

import pytest

from depotlane.operators import basket, graph

SCORED = "article_a string, article_b string, layout_score double, shared_transactions long, stability_score double, lift double"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(f"{k:05d}a", f"{k:05d}b", 0.2 + k % 7 / 100, 3, 0.5, 2.0) for k in range(4100)] + [("w", "x", 0.2, 3, 0.5, 2.0), ("x", "y", 0.2, 3, 0.5, 2.0), ("y", "z", 0.2, 3, 0.5, 2.0), ("weak", "w", 0.1, 3, 0.5, 2.0)]
    return basket.graph_edges(spark.createDataFrame(rows, SCORED)).localCheckpoint()


def test_all_strong_pairs_are_edges(edges):
    assert edges.count() == 4103
    assert edges.where("article_b = 'weak' or article_a = 'weak'").isEmpty()


def test_clusters_of_more_than_4000_edges(spark, edges):
    members = graph.clusters(edges)
    items = spark.createDataFrame([("w", 3)], "article string, transaction_frequency long")
    summary = graph.cluster_summary(edges, members, items).collect()
    assert len(summary) == 4101 and [(r.articles, r.edges) for r in summary if r.cluster_id.startswith("w-")] == [("w,x,y,z", 3)]  # in so large a graph the chain gains as a whole


def test_hubs_of_more_than_4000_edges_in_parts(spark, edges, monkeypatch):
    monkeypatch.setattr(graph, "STEPS", 4)  # the chain of 4 items and 3 edges takes 3 tasks
    found = {r.article: r for r in graph.hubs(edges, graph.clusters(edges)).collect()}
    n = 2 * 4100 + 4
    assert len(found) == n and all(found[k].degree == d for k, d in {"w": 1, "x": 2, "y": 2, "z": 1, "00000a": 1}.items())
    scale = 2 / ((n - 1) * (n - 2))
    assert all(abs(found[k].betweenness - b * scale) < 1e-15 for k, b in {"w": 0, "x": 2, "y": 2, "z": 0, "00000a": 0}.items())


def test_merged_communities_follow_each_other():
    chain = [(f"{k:03d}", f"{k + 1:03d}", 1.0) for k in range(0, 300)]
    groups = graph.communities(chain, 300.0)
    assert set(groups) == {f"{k:03d}" for k in range(301)} and sorted(set(groups.values())) == list(range(len(set(groups.values()))))
    for g in set(groups.values()):
        own = sorted(int(k) for k, v in groups.items() if v == g)
        assert own == list(range(own[0], own[-1] + 1))  # pieces of the chain

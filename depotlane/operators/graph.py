"""Communities and hubs of an item graph."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from depotlane.lineage import cut


def components(edges: DataFrame, a: str = "article_a", b: str = "article_b") -> DataFrame:
    """(article, component): the least article that each one reaches, by spreading least labels."""
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))))
    labels = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label"))
    while True:
        near = both.join(labels.toDF("y", "near"), "y").groupBy("x").agg(F.min("near").alias("near"))
        step = cut(labels.join(near, "x").select("x", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")))
        labels = step.select("x", "label")
        if step.where("moved").isEmpty():
            return labels.toDF("article", "component")


def communities(edges: list[tuple[str, str, float]], total: float) -> dict[str, int]:
    """Greedy modularity: merges the pair of communities that gains most until none gains.

    `total` is the weight of all edges of the whole graph, so components may be settled one by
    one. Of equal gains the one of the least labels is taken.
    """
    links: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in edges:
        links[a][b] = links[a].get(b, 0.0) + w
        links[b][a] = links[b].get(a, 0.0) + w
    degree = {n: sum(x.values()) for n, x in links.items()}
    into: dict[str, str] = {}
    tiny = 1e-12 / max(total, 1.0)  # gains shrink as the graph grows
    gain = lambda a, b: links[a][b] / total - degree[a] * degree[b] / (2 * total * total)
    queue = [(-gain(a, b), a, b) for a in links for b in links[a] if a < b]
    heapq.heapify(queue)
    while queue:
        g, a, b = heapq.heappop(queue)
        if a not in links or b not in links[a] or abs(-g - gain(a, b)) > tiny:
            continue  # stale
        if -g <= tiny:
            break
        for n, w in links.pop(b).items():
            del links[n][b]
            if n != a:
                links[a][n] = links[n][a] = links[a].get(n, 0.0) + w
        degree[a] += degree.pop(b)
        into[b] = a
        for n in links[a]:
            x, y = sorted((a, n))
            heapq.heappush(queue, (-gain(x, y), x, y))
    home = {n: n for n in links}
    for b in reversed(into):  # what b went into is placed before b
        home[b] = home[into[b]]
    sizes = Counter(home.values())
    order = {h: k for k, h in enumerate(sorted(sizes, key=lambda h: (-sizes[h], h)))}
    return {n: order[h] for n, h in home.items()}


def betweenness(edges: list[tuple[str, str, float]], sources: Iterable[str] | None = None) -> dict[str, float]:
    """Share of shortest paths (weights as lengths) that pass each node, per unordered pair, not normalised.

    sources: where paths start, so that the shares of parts of the nodes add up to those of all.
    """
    links: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in edges:
        links[a][b] = links[b][a] = w
    score = dict.fromkeys(links, 0.0)
    for source in links if sources is None else sources:
        far, paths, before, done = {source: 0.0}, defaultdict(float, {source: 1.0}), defaultdict(list), []
        queue, seen = [(0.0, source)], set()
        while queue:
            d, n = heapq.heappop(queue)
            if n in seen:
                continue
            seen.add(n)
            done.append(n)
            for m, w in links[n].items():
                reach = d + w
                if m not in far or reach < far[m] - 1e-12:
                    far[m], paths[m], before[m] = reach, paths[n], [n]
                    heapq.heappush(queue, (reach, m))
                elif abs(reach - far[m]) <= 1e-12 and m not in seen:
                    paths[m] += paths[n]
                    before[m].append(n)
        share = dict.fromkeys(done, 0.0)
        for n in reversed(done):
            for m in before[n]:
                share[m] += paths[m] / paths[n] * (1 + share[n])
            if n != source:
                score[n] += share[n] / 2
    return score


#: Nodes times edges of a component whose shortest paths one task works out, and the most tasks that share a component.
STEPS, TASKS = 20_000_000, 256


def clusters(edges: DataFrame) -> DataFrame:
    """article, cluster_id (component and number in it) and betweenness (normalised over the whole graph).

    Each component is settled in tasks of its own: communities in one of them, shortest paths in as many as its
    nodes and edges ask for, each from its share of the nodes. Such a task holds the edges of its component.
    """
    whole = edges.agg(F.sum("weight").alias("total")).first()[0] or 1.0
    labels = cut(components(edges))
    n = labels.count()
    scale = 2 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    placed = cut(edges.select("article_a", "article_b", "weight").join(labels.withColumnRenamed("article", "article_a"), "article_a"))
    steps = labels.groupBy("component").agg(F.count("*").alias("nodes")).join(placed.groupBy("component").agg(F.count("*").alias("edges")), "component")
    parts = steps.select("component", F.least(F.lit(TASKS), F.ceil(F.col("nodes") * F.col("edges") / STEPS)).cast("int").alias("parts"))
    dealt = placed.join(parts, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(frame.article_a, frame.article_b, frame.weight, strict=True))
        names, part, parts = sorted({*frame.article_a, *frame.article_b}), frame.part.iloc[0], frame.parts.iloc[0]
        groups = communities(rows, whole) if part == 0 else {}
        centre = betweenness(rows, names[part::parts] if parts > 1 else None)
        return pd.DataFrame({"article": names, "cluster_id": [f"{frame.component.iloc[0]}-{groups[x] + 1}" if groups else None for x in names], "betweenness": [centre[x] * scale for x in names]})

    out = dealt.groupBy("component", "part").applyInPandas(settle, "article string, cluster_id string, betweenness double")
    return out.groupBy("article").agg(F.max("cluster_id").alias("cluster_id"), F.sum("betweenness").alias("betweenness"))


def cluster_summary(edges: DataFrame, members: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """Size, frequency, cohesion, lift and density of each cluster."""
    m = members.select("article", "cluster_id")
    inside = edges.join(m.toDF("article_a", "cluster_id"), "article_a").join(m.toDF("article_b", "other"), "article_b").where("cluster_id = other")
    strength = inside.groupBy("cluster_id").agg(F.avg("weight").alias("cohesion"), F.avg("lift").alias("mean_lift"), F.count("*").alias("edges"))
    size = m.join(items.select("article", "transaction_frequency"), "article", "left").groupBy("cluster_id").agg(F.count("*").alias("size"), F.sum("transaction_frequency").alias("frequency"), F.array_join(F.array_sort(F.collect_list("article")), ",").alias("articles"))
    out = size.where(F.col("size") >= least).join(strength, "cluster_id", "left")
    return out.withColumn("density", F.try_divide(F.col("edges"), F.col("size") * (F.col("size") - 1) / 2))


def hubs(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Degree, weighted degree and betweenness of each item."""
    ends = edges.select(F.explode(F.array("article_a", "article_b")).alias("article"), "weight")
    return ends.groupBy("article").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree")).join(members.select("article", "betweenness"), "article", "left")

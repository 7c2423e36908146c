"""Market-basket queries, over all lines as picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlane.lineage import cut, stored
from depotlane.operators import basket
from depotlane.sources.staging import CTES, picks

#: Transactions that a pair shares at least: the staged baskets are thin.
LEAST = 2
#: The strongest edges that the queries compared with SQL list; clusters and hubs take all.
STRONGEST = 4000


def _lines(spark, sf_dir):
    return basket.basket_lines(picks(spark, sf_dir))


def _items(spark, sf_dir):
    return basket.transaction_items(_lines(spark, sf_dir))


def _baskets(spark, sf_dir):
    """What pairs need of each transaction, written once, as several parts of a query read it.

    Staged lines are joined by order, and a transaction lies in one order, so all stays where that join puts it.
    """
    order = "o_orderkey"
    lines = basket.basket_lines(picks(spark, sf_dir, order), order).repartition(order)
    return stored(basket.whole_baskets(basket.transaction_items(lines, order), order))


def _thin(spark, sf_dir):
    """What pairs need of the items."""
    return basket.basket_rows(_baskets(spark, sf_dir))


def _round(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def basket_items(spark, sf_dir):
    return _items(spark, sf_dir)


def basket_transactions(spark, sf_dir):
    return _round(basket.transactions(_lines(spark, sf_dir)), "dispersion")


def basket_transactions_mode(spark, sf_dir):
    return basket.transactions(_lines(spark, sf_dir), "mode").select("transaction_id", "transaction_date", "month")


def basket_item_sets(spark, sf_dir):
    out = basket.item_sets(_items(spark, sf_dir))
    entries = F.array_sort(F.map_entries("quantities"))
    text = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string")))
    return out.select("transaction_id", F.array_join("items", ",").alias("items"), F.array_join(text, ",").alias("quantities"))


def basket_sku_locations(spark, sf_dir):
    return _round(basket.sku_locations(_lines(spark, sf_dir)), "share")


def basket_sku_attributes(spark, sf_dir):
    return _round(basket.sku_attributes(_lines(spark, sf_dir)), "dominant_share")


def basket_pairs(spark, sf_dir):
    return basket.pair_counts(_items(spark, sf_dir))


def basket_threshold(spark, sf_dir):
    items = _thin(spark, sf_dir)
    return basket.min_pair_transactions(basket.pair_counts(items), items.agg(F.countDistinct("transaction_id").alias("total")))


_METRICS = ("support_a", "support_b", "joint_support", "confidence_a_b", "confidence_b_a", "expected_support", "lift", "leverage", "conviction_a_b", "conviction_b_a", "balanced_confidence", "jaccard", "cosine", "weighted_cosine", "pmi", "max_item_support", "npmi", "popularity_factor")


def basket_pair_metrics(spark, sf_dir):
    return _round(basket.pair_metrics(_thin(spark, sf_dir), LEAST), *_METRICS, digits=6)


def basket_item_metrics(spark, sf_dir):
    return _round(basket.item_metrics(_items(spark, sf_dir), 0.001), "support", "mean_quantity", digits=6)


def basket_rules(spark, sf_dir):
    out = basket.rules(basket.pair_metrics(_thin(spark, sf_dir), LEAST))
    return _round(out, "antecedent_support", "consequent_support", "confidence", "conviction", "support", "lift", "leverage", "npmi", digits=6)


def basket_temporal_pairs(spark, sf_dir):
    baskets = _baskets(spark, sf_dir)
    out = basket.temporal_pairs(basket.basket_rows(baskets), totals=basket.basket_totals(baskets)).select("period", "article_a", "article_b", "period_transactions", "shared_transactions", "joint_support", "lift", "balanced_confidence", "jaccard", "npmi")
    return _round(out, "joint_support", "lift", "balanced_confidence", "jaccard", "npmi", digits=6)


def _temporal(baskets, at_least=1):
    """Pair metrics by period, dealt by pair, with the start of each period, and the number of periods that have pairs."""
    items = basket.basket_rows(baskets)
    last = items.agg(F.max(F.to_date("last_completion_date"))).first()[0]
    totals = cut(basket.with_period_start(basket.basket_totals(baskets), str(last), "label"))
    return basket.temporal_pairs(items, at_least=at_least, totals=totals, by_pair=True), totals.agg(F.count_if("paired").alias("available"))


def _steady(spark, sf_dir):
    return basket.stability(*_temporal(_baskets(spark, sf_dir)))


def basket_stability(spark, sf_dir):
    out = _steady(spark, sf_dir).select("article_a", "article_b", "periods_present", "support_mean", "support_max", "support_stability", "lift_stability", "support_trend", "lift_trend", "trend", "presence_ratio", "stability_score")
    return _round(out, "support_mean", "support_max", "support_stability", "lift_stability", "presence_ratio", "stability_score", digits=6)


def _parts(spark, sf_dir):
    """Items, stability and scored pairs of those that share LEAST transactions, all from one pairing."""
    baskets = _baskets(spark, sf_dir)
    temporal, available = _temporal(baskets, LEAST)
    temporal = cut(temporal)
    steady = cut(basket.stability(temporal, available))
    return basket.basket_rows(baskets), steady, basket.layout_scores(basket.pairs_of_history(temporal.drop("period_start"), LEAST), steady)


def _scored(spark, sf_dir):
    return _parts(spark, sf_dir)[2]


def basket_layout_scores(spark, sf_dir):
    out = _scored(spark, sf_dir).select("article_a", "article_b", "shared_transactions", "lift_component", "similarity_component", "weighted_score", "relevance_factor", "layout_score", "proximity", "same_slot_area", "same_zone", "manual_review", "hint")
    return _round(out, "lift_component", "similarity_component", "weighted_score", "relevance_factor", "layout_score", digits=6)


def basket_graph_edges(spark, sf_dir):
    return _round(basket.graph_edges(_scored(spark, sf_dir), 0.18, LEAST, STRONGEST), "weight", "lift", digits=6)


def basket_similarity_matrix(spark, sf_dir):
    items, _, scored = _parts(spark, sf_dir)
    return _round(basket.similarity_matrix(scored, basket.item_metrics(items)), "score", digits=6)


def basket_describe(spark, sf_dir):
    return _round(basket.describe(basket.transactions(_lines(spark, sf_dir))), "value", digits=6)


def basket_owner_items(spark, sf_dir):
    return basket.owner_items(_items(spark, sf_dir))


def basket_item_summary(spark, sf_dir):
    return _round(basket.item_summary(basket.owner_items(_items(spark, sf_dir))), "mean_quantity", digits=6)


def basket_highlights(spark, sf_dir):
    _, steady, scored = _parts(spark, sf_dir)
    return _round(basket.highlights(scored, steady), "layout_score", "lift", digits=6)


def basket_series(spark, sf_dir):
    baskets = _baskets(spark, sf_dir)
    described = basket.describe(basket.basket_figures(baskets))
    temporal = basket.temporal_pairs(basket.basket_rows(baskets), totals=basket.basket_totals(baskets))
    return _round(basket.unified_series(described, temporal), "value", digits=6)


_BASE = f"""WITH {CTES}, l AS (SELECT external_order_id || '|' || owner AS transaction_id, external_order_id, owner, sku AS article, sku_description, location, quantity, coalesce(completed_at, started_at) AS completion_date
  FROM movements WHERE sku IS NOT NULL AND external_order_id IS NOT NULL AND owner IS NOT NULL AND quantity > 0),
i AS (SELECT transaction_id, external_order_id, owner, article, sum(quantity) AS quantity_sum, count(*) AS line_count, min(sku_description) AS article_description, min(location) AS primary_location,
  count(DISTINCT location) AS unique_locations, min(completion_date) AS first_completion_date, max(completion_date) AS last_completion_date FROM l GROUP BY ALL)"""
_DATES = "strftime(transaction_date, '%Y-%m') AS month"
_TX = f"""t AS (SELECT transaction_id, external_order_id, owner, count(*) AS basket_size, sum(quantity_sum) AS total_quantity, count(*) FILTER (line_count > 1) AS repeated_lines, min(first_completion_date) AS transaction_start, max(last_completion_date) AS transaction_end FROM i GROUP BY ALL),
pl AS (SELECT transaction_id, count(DISTINCT coalesce(location, '[missing]')) AS locations, max(completion_date) AS transaction_date FROM l GROUP BY ALL),
x AS (SELECT t.*, locations, transaction_date, repeated_lines > 0 AS repeated_flag, round(locations / basket_size, 9) AS dispersion, year(transaction_date)::INT AS year, year(transaction_date) || 'Q' || quarter(transaction_date) AS quarter, {_DATES} FROM t JOIN pl USING (transaction_id))"""
_LOC = """lo AS (SELECT article, location, count(*) AS observations, max(completion_date) AS last_seen FROM l WHERE location IS NOT NULL GROUP BY ALL),
lp AS (SELECT *, observations / sum(observations) OVER (PARTITION BY article) AS share, row_number() OVER (PARTITION BY article ORDER BY observations DESC, last_seen DESC NULLS LAST, location) = 1 AS "primary" FROM lo)"""
_PC = """pc AS (SELECT a.article AS article_a, b.article AS article_b, count(*) AS shared_transactions, sum(least(a.quantity_sum, b.quantity_sum)) AS shared_quantity FROM i a JOIN i b ON a.transaction_id = b.transaction_id AND a.article < b.article GROUP BY ALL)"""
_EACH = "e AS (SELECT article, count(DISTINCT transaction_id) AS n, sum(quantity_sum) AS q FROM i GROUP BY article), tot AS (SELECT count(DISTINCT transaction_id) AS total FROM i)"


def _metric_ctes(source: str) -> str:
    return f"""m1 AS (SELECT *, n_a / total AS support_a, n_b / total AS support_b, shared_transactions / total AS joint_support, shared_transactions / n_a AS confidence_a_b, shared_transactions / n_b AS confidence_b_a FROM {source}),
m2 AS (SELECT *, support_a * support_b AS expected_support FROM m1),
m3 AS (SELECT *, joint_support / expected_support AS lift, joint_support - expected_support AS leverage, CASE WHEN confidence_a_b >= 1 THEN 'inf'::DOUBLE ELSE (1 - support_b) / (1 - confidence_a_b) END AS conviction_a_b,
  CASE WHEN confidence_b_a >= 1 THEN 'inf'::DOUBLE ELSE (1 - support_a) / (1 - confidence_b_a) END AS conviction_b_a, 2 / (1 / confidence_a_b + 1 / confidence_b_a) AS balanced_confidence, shared_transactions / (n_a + n_b - shared_transactions) AS jaccard,
  shared_transactions / sqrt(n_a * n_b) AS cosine, shared_quantity / sqrt(q_a * q_b) AS weighted_cosine, ln(joint_support / expected_support) AS pmi, greatest(support_a, support_b) AS max_item_support FROM m2),
met AS (SELECT * EXCLUDE (n_a, n_b, q_a, q_b), CASE WHEN joint_support <> 1 THEN pmi / -ln(joint_support) ELSE 0 END AS npmi, 1 / (1 + 2.0 * max_item_support) AS popularity_factor FROM m3)"""


_PM = f"{_PC}, {_EACH}, src AS (SELECT pc.*, a.n AS n_a, b.n AS n_b, a.q AS q_a, b.q AS q_b, total FROM pc JOIN e a ON a.article = article_a JOIN e b ON b.article = article_b, tot WHERE shared_transactions >= {LEAST}), {_metric_ctes('src')}"
_TP = f"""lastd AS (SELECT max(last_completion_date) AS last FROM i),
ip AS (SELECT i.*, unnest(list_filter(['full_history', CASE WHEN last_completion_date >= last - INTERVAL 365 DAY THEN 'last_365_days' END, CASE WHEN last_completion_date >= last - INTERVAL 180 DAY THEN 'last_180_days' END, CASE WHEN last_completion_date >= last - INTERVAL 90 DAY THEN 'last_90_days' END,
  'year_' || year(last_completion_date), 'quarter_' || year(last_completion_date) || 'Q' || quarter(last_completion_date)], lambda z: z IS NOT NULL)) AS period FROM i, lastd),
pt AS (SELECT period, count(DISTINCT transaction_id) AS total FROM ip GROUP BY period HAVING count(DISTINCT transaction_id) >= 2),
pe AS (SELECT period, article, count(DISTINCT transaction_id) AS n, sum(quantity_sum) AS q FROM ip GROUP BY ALL),
pp AS (SELECT a.period, a.article AS article_a, b.article AS article_b, count(*) AS shared_transactions, sum(least(a.quantity_sum, b.quantity_sum)) AS shared_quantity FROM ip a JOIN ip b ON a.period = b.period AND a.transaction_id = b.transaction_id AND a.article < b.article GROUP BY ALL),
tsrc AS (SELECT pp.*, a.n AS n_a, b.n AS n_b, a.q AS q_a, b.q AS q_b, total FROM pp JOIN pt USING (period) JOIN pe a ON a.period = pp.period AND a.article = article_a JOIN pe b ON b.period = pp.period AND b.article = article_b)"""
_TM = f"{_TP}, {_metric_ctes('tsrc').replace('m1', 't1').replace('m2', 't2').replace('m3', 't3').replace('met AS', 'tmet AS')}"
_ST = f"""{_TM}, av AS (SELECT count(DISTINCT period) AS available FROM tmet),
starts AS (SELECT tmet.*, CASE WHEN period LIKE 'last_%' THEN last::DATE - replace(split_part(period, '_', 2), '_', '')::INT WHEN period LIKE 'year_%' THEN make_date(substr(period, 6, 4)::INT, 1, 1) WHEN period LIKE 'quarter_%' THEN make_date(substr(period, 9, 4)::INT, right(period, 1)::INT * 3 - 2, 1) END AS ps FROM tmet, lastd),
lv AS (SELECT article_a, article_b, count(*) AS periods_present, avg(joint_support) AS support_mean, max(joint_support) AS support_max, 1 / (1 + stddev_pop(joint_support) / avg(joint_support)) AS support_stability, 1 / (1 + stddev_pop(lift) / avg(lift)) AS lift_stability FROM tmet GROUP BY ALL),
pl2 AS (SELECT *, row_number() OVER (PARTITION BY article_a, article_b ORDER BY ps, CASE WHEN period LIKE 'last_%' THEN 1 WHEN period LIKE 'year_%' THEN 2 ELSE 3 END, period)::DOUBLE AS px FROM starts WHERE period <> 'full_history'),
sl AS (SELECT article_a, article_b, CASE WHEN count(*) > 1 THEN regr_slope(joint_support, px) ELSE 0 END AS ss, CASE WHEN count(*) > 1 THEN regr_slope(lift, px) ELSE 0 END AS ls, avg(joint_support) AS sm, avg(lift) AS lm FROM pl2 GROUP BY ALL),
tr AS (SELECT article_a, article_b, CASE WHEN ss > greatest(abs(sm) * 0.05, 1e-6) THEN 'growing' WHEN ss < -greatest(abs(sm) * 0.05, 1e-6) THEN 'declining' ELSE 'stable' END AS support_trend, CASE WHEN ls > greatest(abs(lm) * 0.05, 1e-6) THEN 'growing' WHEN ls < -greatest(abs(lm) * 0.05, 1e-6) THEN 'declining' ELSE 'stable' END AS lift_trend FROM sl),
stab AS (SELECT lv.*, support_trend, lift_trend, CASE WHEN support_trend = lift_trend THEN support_trend WHEN support_trend IS NOT NULL THEN 'stable' END AS trend, periods_present / available AS presence_ratio,
  0.40 * (periods_present / available) + 0.25 * support_stability + 0.20 * lift_stability + 0.15 * CASE WHEN coalesce(support_trend, 'stable') <> 'declining' THEN 1 ELSE 0 END AS stability_score FROM lv LEFT JOIN tr USING (article_a, article_b), av)"""
_SC = f"""{_PM}, {_ST}, s1 AS (SELECT met.*, coalesce(stability_score, 0) AS stability_score, coalesce(presence_ratio, 0) AS presence_ratio, ln(1 + greatest(lift - 1, 0)) AS ll, trend, support_trend, lift_trend FROM met LEFT JOIN stab USING (article_a, article_b)),
cap AS (SELECT max(shared_transactions) AS max_n, max(shared_quantity) AS max_q, quantile_cont(ll, 0.9) AS cap_l, max(ll) AS max_l, quantile_cont(balanced_confidence, 0.95) AS cap_c, quantile_cont(shared_transactions, 0.99) AS p99, min(shared_transactions) AS min_n, quantile_cont(shared_transactions, 0.5) AS median_n FROM s1),
s2 AS (SELECT *, ln(1 + shared_transactions) / ln(1 + max_n) AS fc, CASE WHEN cap_l > 0 THEN least(ll, cap_l) / cap_l ELSE least(ll, greatest(cap_l, max_l, 1e-9)) / greatest(cap_l, max_l, 1e-9) END AS lift_component, least(balanced_confidence, cap_c) / cap_c AS cc,
  (jaccard + cosine + least(weighted_cosine, 1) + least(greatest(npmi, 0), 1)) / 4 AS similarity_component, ln(1 + shared_quantity) / ln(1 + max_q) AS vc, least(greatest(stability_score, 0), 1) AS tc FROM s1, cap),
s3 AS (SELECT *, 0.30 * fc + 0.12 * lift_component + 0.14 * cc + 0.12 * similarity_component + 0.20 * tc + 0.12 * vc AS weighted_score, least(greatest(shared_transactions / greatest(floor(p99), min_n, 1), 0.25), 1.0) * (0.4 + 0.6 * presence_ratio) AS relevance_factor FROM s2),
s4 AS (SELECT *, least(greatest(weighted_score * relevance_factor * least(greatest(popularity_factor, 0.1), 1.0), 0), 1) AS layout_score FROM s3),
s5 AS (SELECT *, CASE WHEN layout_score <= 0.25 THEN 'low' WHEN layout_score <= 0.45 THEN 'medium' WHEN layout_score <= 0.65 THEN 'high' ELSE 'very_high' END AS proximity, layout_score >= 0.65 AND shared_transactions >= median_n AND stability_score >= 0.55 AS same_slot_area FROM s4),
sc AS (SELECT *, layout_score >= 0.45 AND NOT same_slot_area AS same_zone, (lift_component >= 0.70 AND fc < 0.35) OR (layout_score >= 0.45 AND presence_ratio < 0.40) AS manual_review FROM s5)"""
_R = lambda names, d=6: ", ".join(f"round({n}, {d}) AS {n}" for n in names)
_COUNT = "shared_transactions::BIGINT AS shared_transactions"

QUERIES = {
    f.__name__: f
    for f in (
        basket_items, basket_transactions, basket_transactions_mode, basket_item_sets, basket_sku_locations, basket_sku_attributes, basket_pairs, basket_threshold, basket_pair_metrics, basket_item_metrics,
        basket_rules, basket_temporal_pairs, basket_stability, basket_layout_scores, basket_graph_edges, basket_similarity_matrix, basket_describe, basket_owner_items, basket_item_summary, basket_highlights, basket_series,
    )
}
ORACLES = {
    "basket_items": f"{_BASE} SELECT * FROM i",
    "basket_transactions": f"{_BASE}, {_TX} SELECT * FROM x",
    "basket_transactions_mode": f"{_BASE}, d AS (SELECT transaction_id, completion_date::DATE AS day, count(*) AS n, max(completion_date) AS last FROM l GROUP BY ALL), o AS (SELECT transaction_id, arg_max(last, (n, day)) AS transaction_date FROM d GROUP BY ALL) SELECT *, {_DATES} FROM o",
    "basket_item_sets": f"{_BASE} SELECT transaction_id, string_agg(article, ',' ORDER BY article) AS items, string_agg(article || '=' || quantity_sum::BIGINT, ',' ORDER BY article) AS quantities FROM i GROUP BY ALL",
    "basket_sku_locations": f"{_BASE}, {_LOC} SELECT * REPLACE (round(share, 9) AS share) FROM lp",
    "basket_sku_attributes": f"""{_BASE}, {_LOC}, w AS (SELECT article, sku_description, count(*) AS n FROM l GROUP BY ALL), mo AS (SELECT article, arg_min(sku_description, (-n, sku_description)) AS description, count(*) AS descriptions FROM w GROUP BY ALL),
pl AS (SELECT article, count(*) AS locations, round(max(share), 9) AS dominant_share, max(location) FILTER ("primary") AS primary_location, arg_min(location, (-epoch(last_seen), location)) AS latest_location FROM lp GROUP BY ALL)
SELECT article, description, descriptions, coalesce(locations, 0) AS locations, dominant_share, primary_location, latest_location, coalesce(locations, 0) > 1 AS multi_location FROM mo LEFT JOIN pl USING (article)""",
    "basket_pairs": f"{_BASE}, {_PC} SELECT * FROM pc",
    "basket_threshold": f"{_BASE}, {_PC}, {_EACH} SELECT greatest(3, ceil(total * 0.0002), floor(greatest(3, least(5, (SELECT quantile_cont(shared_transactions, 0.95) FROM pc)))))::BIGINT AS min_pair_transactions FROM tot",
    "basket_pair_metrics": f"{_BASE}, {_PM} SELECT article_a, article_b, shared_transactions, shared_quantity, {_R(_METRICS)} FROM met",
    "basket_item_metrics": f"{_BASE} SELECT article, count(DISTINCT transaction_id) AS transaction_frequency, count(*) AS row_frequency, sum(quantity_sum) AS total_quantity, round(avg(quantity_sum), 6) AS mean_quantity, round(count(DISTINCT transaction_id) / (SELECT count(DISTINCT transaction_id) FROM i), 6) AS support, count(DISTINCT transaction_id) / (SELECT count(DISTINCT transaction_id) FROM i) > 0.001 AS too_frequent FROM i GROUP BY article",
    "basket_rules": f"""{_BASE}, {_PM}, r AS (SELECT article_a AS antecedent, article_b AS consequent, support_a AS antecedent_support, support_b AS consequent_support, confidence_a_b AS confidence, conviction_a_b AS conviction, joint_support AS support, lift, leverage, npmi, shared_transactions FROM met
UNION ALL SELECT article_b, article_a, support_b, support_a, confidence_b_a, conviction_b_a, joint_support, lift, leverage, npmi, shared_transactions FROM met), o AS (SELECT * FROM r WHERE confidence >= 0.05 AND lift >= 1.05 ORDER BY lift DESC, confidence DESC, shared_transactions DESC, antecedent, consequent LIMIT 20000)
SELECT antecedent, consequent, shared_transactions, {_R(['antecedent_support', 'consequent_support', 'confidence', 'conviction', 'support', 'lift', 'leverage', 'npmi'])} FROM o""",
    "basket_temporal_pairs": f"{_BASE}, {_TM} SELECT period, article_a, article_b, total AS period_transactions, shared_transactions, {_R(['joint_support', 'lift', 'balanced_confidence', 'jaccard', 'npmi'])} FROM tmet",
    "basket_stability": f"{_BASE}, {_ST} SELECT article_a, article_b, periods_present, support_trend, lift_trend, trend, {_R(['support_mean', 'support_max', 'support_stability', 'lift_stability', 'presence_ratio', 'stability_score'])} FROM stab",
    "basket_layout_scores": f"""{_BASE}, {_SC} SELECT article_a, article_b, shared_transactions, proximity, same_slot_area, same_zone, manual_review, {_R(['lift_component', 'similarity_component', 'weighted_score', 'relevance_factor', 'layout_score'])},
CASE WHEN same_slot_area THEN 'place side by side' WHEN same_zone THEN 'keep in one zone' WHEN manual_review THEN 'review by hand' ELSE 'monitor' END AS hint FROM sc""",
    "basket_graph_edges": f"{_BASE}, {_SC} SELECT article_a, article_b, round(layout_score, 6) AS weight, round(lift, 6) AS lift, shared_transactions FROM (SELECT * FROM sc WHERE layout_score >= 0.18 AND shared_transactions >= {LEAST} ORDER BY layout_score DESC, shared_transactions DESC, stability_score DESC, lift DESC, article_a, article_b LIMIT 4000)",
    "basket_similarity_matrix": f"""{_BASE}, {_SC}, top AS (SELECT article FROM i GROUP BY article ORDER BY count(DISTINCT transaction_id) DESC, article LIMIT 20), k AS (SELECT article_a AS a, article_b AS b, layout_score FROM sc UNION ALL SELECT article_b, article_a, layout_score FROM sc)
SELECT r.article AS "row", c.article AS "column", round(CASE WHEN r.article = c.article THEN 1 ELSE coalesce(layout_score, 0) END, 6) AS score FROM top r CROSS JOIN top c LEFT JOIN k ON a = r.article AND b = c.article""",
    "basket_describe": f"""{_BASE}, {_TX}, g AS (SELECT 'overall' AS section, 'all' AS key, basket_size, total_quantity FROM x UNION ALL SELECT 'year', year::VARCHAR, basket_size, total_quantity FROM x UNION ALL SELECT 'quarter', quarter, basket_size, total_quantity FROM x
UNION ALL SELECT 'month', month, basket_size, total_quantity FROM x UNION ALL SELECT 'basket_size', basket_size::VARCHAR, basket_size, total_quantity FROM x), a AS (SELECT section, key, count(*)::DOUBLE AS transactions, avg(basket_size)::DOUBLE AS mean_basket, quantile_cont(basket_size, 0.5)::DOUBLE AS median_basket, sum(total_quantity)::DOUBLE AS quantity FROM g GROUP BY ALL)
SELECT section, key, metric, round(value, 6) AS value FROM (UNPIVOT a ON transactions, mean_basket, median_basket, quantity INTO NAME metric VALUE value)""",
    "basket_owner_items": f"{_BASE} SELECT owner, article, count(DISTINCT transaction_id) AS transaction_frequency, count(*) AS row_frequency, sum(quantity_sum) AS total_quantity, min(last_completion_date) AS first_seen, max(last_completion_date) AS last_seen FROM i GROUP BY ALL",
    "basket_item_summary": f"{_BASE} SELECT article, count(DISTINCT transaction_id)::BIGINT AS transaction_frequency, count(*)::BIGINT AS row_frequency, sum(quantity_sum) AS total_quantity, count(DISTINCT owner) AS owner_count, min(last_completion_date) AS first_seen, max(last_completion_date) AS last_seen, round(avg(quantity_sum), 6) AS mean_quantity FROM i GROUP BY ALL",
    "basket_series": f"""{_BASE}, {_TX}, {_TM}, g AS (SELECT 'year' AS granularity, year::VARCHAR AS period, basket_size, total_quantity FROM x UNION ALL SELECT 'quarter', quarter, basket_size, total_quantity FROM x UNION ALL SELECT 'month', month, basket_size, total_quantity FROM x),
a AS (SELECT granularity, period, count(*)::DOUBLE AS transactions, avg(basket_size)::DOUBLE AS mean_basket, quantile_cont(basket_size, 0.5)::DOUBLE AS median_basket, sum(total_quantity)::DOUBLE AS quantity FROM g GROUP BY ALL),
b AS (SELECT CASE WHEN period = 'full_history' THEN period ELSE split_part(period, '_', 1) END AS granularity, period, article_a, article_b, shared_transactions::DOUBLE AS shared_transactions, joint_support::DOUBLE AS joint_support, lift::DOUBLE AS lift, jaccard::DOUBLE AS jaccard, npmi::DOUBLE AS npmi FROM tmet)
SELECT 'aggregate_transactions' AS series_type, granularity, period, NULL::VARCHAR AS article_a, NULL::VARCHAR AS article_b, metric, round(value, 6) AS value FROM (UNPIVOT a ON transactions, mean_basket, median_basket, quantity INTO NAME metric VALUE value)
UNION ALL SELECT 'pair_affinity', granularity, period, article_a, article_b, metric, round(value, 6) FROM (UNPIVOT b ON shared_transactions, joint_support, lift, jaccard, npmi INTO NAME metric VALUE value)""",
    "basket_highlights": f"""{_BASE}, {_SC}, h AS (SELECT 'best' AS list, *, row_number() OVER (ORDER BY layout_score DESC, shared_transactions DESC, article_a, article_b) AS k FROM sc
UNION ALL SELECT 'strong_but_rare', *, row_number() OVER (ORDER BY lift DESC, shared_transactions, article_a, article_b) FROM sc UNION ALL SELECT 'emerging', *, row_number() OVER (ORDER BY layout_score DESC, shared_transactions DESC, article_a, article_b) FROM sc WHERE trend = 'growing' OR support_trend = 'growing' OR lift_trend = 'growing')
SELECT list, article_a, article_b, round(layout_score, 6) AS layout_score, round(lift, 6) AS lift, shared_transactions FROM h WHERE k <= 10""",
}

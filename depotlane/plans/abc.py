"""ABC queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlane.operators import abc
from depotlane.sources.staging import CTES, SNAPSHOT, movements, stock

YEAR, RECENT = "2001-01-01", "2001-05-31"


def _round(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def abc_article(spark, sf_dir):
    out = abc.classify_abc(movements(spark, sf_dir), stock(spark, sf_dir))
    return _round(out, "percentage", "cumulative_percentage", "stock_coverage_lines")


def _since(spark, sf_dir, start):
    return abc.abc_since(movements(spark, sf_dir), stock(spark, sf_dir), SNAPSHOT, start)


_RATIOS = ("percentage", "cumulative_percentage", "coverage_lines", "coverage_units", "stock_density")


def abc_owner_ytd(spark, sf_dir):
    return _round(_since(spark, sf_dir, YEAR)[0], *_RATIOS)


def abc_article_ytd(spark, sf_dir):
    return _round(_since(spark, sf_dir, YEAR)[1], *_RATIOS)


def abc_article_30d(spark, sf_dir):
    return _round(_since(spark, sf_dir, RECENT)[1], *_RATIOS)


def abc_quarterly(spark, sf_dir):
    return _round(abc.abc_quarterly(movements(spark, sf_dir), stock(spark, sf_dir), SNAPSHOT), *_RATIOS)


def abc_quarterly_owner(spark, sf_dir):
    return _round(abc.abc_quarterly(movements(spark, sf_dir), stock(spark, sf_dir), SNAPSHOT, ("owner", "sku"), within_quarter=True), *_RATIOS)


def abc_transitions(spark, sf_dir):
    return abc.abc_transitions(abc.abc_quarterly(movements(spark, sf_dir), stock(spark, sf_dir), SNAPSHOT))


def abc_monthly_activity(spark, sf_dir):
    return abc.activity(abc.split(movements(spark, sf_dir))[0], F.date_format("operational_date", "yyyy-MM"))


def abc_temporality(spark, sf_dir):
    out = abc.temporality(abc.split(movements(spark, sf_dir))[0], _since(spark, sf_dir, YEAR)[1])
    return _round(out, "mean_lines", "std_lines", "cv_lines", digits=6)


def abc_decision_counts(spark, sf_dir):
    return abc.decision_counts(abc.temporality(abc.split(movements(spark, sf_dir))[0], _since(spark, sf_dir, YEAR)[1]))


def abc_candidates(spark, sf_dir):
    return abc.relocation_candidates(abc.classify_abc(movements(spark, sf_dir), stock(spark, sf_dir))).select("sku", "abc_class", "lines", "stock_quantity", "relocation_advice")


def abc_class_summary(spark, sf_dir):
    owner, article = _since(spark, sf_dir, YEAR)
    return abc.class_summary(owner, "owner_ytd").unionByName(abc.class_summary(article, "article_ytd"))


def abc_kpis(spark, sf_dir):
    owner, article = _since(spark, sf_dir, YEAR)
    return abc.abc_kpis(owner, article, stock(spark, sf_dir))


def _rank_sql(source, keys, part=""):
    by = f"PARTITION BY {part} " if part else ""
    order = f"ORDER BY lines DESC, units DESC, {', '.join(keys)}"
    return f"""SELECT *, row_number() OVER ({by}{order}) AS rank, sum(lines) OVER ({by}{order} ROWS UNBOUNDED PRECEDING) AS cum, sum(lines) OVER ({by}) AS total FROM {source}"""


_GRADE = "CASE WHEN total <= 0 THEN 'D' WHEN (cum - lines) * 100 < 80 * total THEN 'A' WHEN (cum - lines) * 100 < 95 * total THEN 'B' ELSE 'C' END"
_SHARES = f"{_GRADE} AS abc_class, round(lines / total, 9) AS percentage, round(cum / total, 9) AS cumulative_percentage"
_TWO = "pi AS (SELECT * FROM movements WHERE movement_type = 'PI' AND sku IS NOT NULL), cr AS (SELECT * FROM movements WHERE movement_type = 'CR' AND sku IS NOT NULL)"


def _agg_sql(keys, start=None, quarter=False):
    where = f"WHERE operational_date >= DATE '{start}'" if start else ""
    period = "year(operational_date)::VARCHAR || 'Q' || quarter(operational_date)::VARCHAR AS period, " if quarter else ""
    k = ", ".join(keys)
    held = [x for x in keys if x != "period"]
    on = lambda a, names: " AND ".join(f"p.{x} IS NOT DISTINCT FROM {a}.{x}" for x in names)
    return f"""p AS (SELECT {k}, min(sku_description) AS description, count(*) AS lines, sum(quantity) AS units, count(DISTINCT external_order_id) AS orders, count(DISTINCT location) AS locations,
  min(operational_date) AS first_pick, max(operational_date) AS last_pick, count(DISTINCT operational_date) AS pick_days FROM (SELECT {period}* FROM pi {where}) GROUP BY {k}),
r AS (SELECT {k}, count(*) AS receipt_lines, max(operational_date) AS last_receipt FROM (SELECT {period}* FROM cr {where}) GROUP BY {k}),
h AS (SELECT {', '.join(held)}, sum(stock_quantity) AS stock, count(DISTINCT location) AS stock_locations FROM stock GROUP BY ALL),
agg AS (SELECT p.*, coalesce(receipt_lines, 0) AS receipt_lines, last_receipt, coalesce(stock, 0) AS stock, coalesce(stock_locations, 0) AS stock_locations
  FROM p LEFT JOIN r ON {on('r', keys)} LEFT JOIN h ON {on('h', held)})"""


_OUT = f"""date_diff('day', last_pick, DATE '{SNAPSHOT}')::INT AS days_since_pick, round(stock / lines, 9) AS coverage_lines, round(stock / nullif(units, 0), 9) AS coverage_units, round(stock / nullif(stock_locations, 0), 9) AS stock_density"""
_COUNTS = "lines::BIGINT AS lines, units, orders::BIGINT AS orders, locations::BIGINT AS locations, first_pick, last_pick, pick_days::BIGINT AS pick_days, receipt_lines::BIGINT AS receipt_lines, last_receipt, stock, stock_locations::BIGINT AS stock_locations"
_ROLL = """roll AS (SELECT sku, min(description) AS description, sum(lines) AS lines, sum(units) AS units, sum(orders) AS orders, sum(locations) AS locations, min(first_pick) AS first_pick, max(last_pick) AS last_pick,
  sum(pick_days) AS pick_days, sum(receipt_lines) AS receipt_lines, max(last_receipt) AS last_receipt, sum(stock) AS stock, sum(stock_locations) AS stock_locations FROM agg GROUP BY sku)"""


def _full(keys, source, part="", start=None, quarter=False, roll=False):
    parts = [CTES, _TWO, _agg_sql(["owner", "sku"] if roll else keys, start, quarter), *([_ROLL] if roll else []), f"ranked AS ({_rank_sql(source, keys, part)})"]
    return f"WITH {', '.join(parts)}"


def _select(keys):
    return f"SELECT {', '.join(keys)}, description, {_COUNTS}, {_OUT}, rank::BIGINT AS rank, {_SHARES} FROM ranked"


_CLASSIFIED = f"""WITH {CTES}, g AS (SELECT sku, min(sku_description) FILTER (movement_type = 'PI') AS sku_description, count(*) FILTER (movement_type = 'PI') AS lines,
  sum(quantity) FILTER (movement_type = 'PI') AS units, max(operational_date) FILTER (movement_type = 'PI') AS last_pi_date, count(*) FILTER (movement_type = 'CR') AS cr_lines,
  max(operational_date) FILTER (movement_type = 'CR') AS last_cr_date FROM movements WHERE sku IS NOT NULL GROUP BY sku),
s AS (SELECT sku, sum(stock_quantity) AS stock_quantity FROM stock GROUP BY sku), b AS (SELECT g.*, stock_quantity FROM g LEFT JOIN s USING (sku) WHERE lines > 0),
ranked AS ({_rank_sql('b', ['sku'])}),
c AS (SELECT sku, sku_description, lines::BIGINT AS lines, units, last_pi_date, cr_lines::BIGINT AS cr_lines, last_cr_date, stock_quantity, rank::BIGINT AS rank, {_SHARES}, stock_quantity / lines AS cover FROM ranked),
o AS (SELECT * EXCLUDE (cover), round(cover, 9) AS stock_coverage_lines, CASE WHEN abc_class = 'A' THEN 'keep accessible' WHEN abc_class = 'B' AND coalesce(cover, 0) > 20 THEN 'review excess stock'
  WHEN abc_class = 'C' AND coalesce(stock_quantity, 0) > 0 THEN 'review for secondary store' ELSE 'keep in main store' END AS relocation_advice FROM c)"""
_YTD = lambda roll: _full(["sku"] if roll else ["owner", "sku"], "roll" if roll else "agg", start=YEAR, roll=roll)
_QUARTERS = _full(["period", "sku"], "agg", quarter=True)

QUERIES = {f.__name__: f for f in (abc_article, abc_owner_ytd, abc_article_ytd, abc_article_30d, abc_quarterly, abc_quarterly_owner, abc_transitions, abc_monthly_activity, abc_temporality, abc_decision_counts, abc_candidates, abc_class_summary, abc_kpis)}
ORACLES = {
    "abc_article": f"{_CLASSIFIED} SELECT * FROM o",
    "abc_candidates": f"{_CLASSIFIED} SELECT sku, abc_class, lines, stock_quantity, relocation_advice FROM o WHERE relocation_advice LIKE 'review%' ORDER BY stock_quantity DESC NULLS LAST, lines, sku LIMIT 500",
    "abc_owner_ytd": f"{_YTD(False)} {_select(['owner', 'sku'])}",
    "abc_article_ytd": f"{_YTD(True)} {_select(['sku'])}",
    "abc_article_30d": f"{_full(['sku'], 'roll', start=RECENT, roll=True)} {_select(['sku'])}",
    "abc_quarterly": f"{_QUARTERS} {_select(['period', 'sku'])}",
    "abc_quarterly_owner": f"{_full(['period', 'owner', 'sku'], 'agg', part='period', quarter=True)} {_select(['period', 'owner', 'sku'])}",
    "abc_transitions": f"""{_QUARTERS}, l AS (SELECT period, sku, lines, stock, abc_class, lag(abc_class) OVER w AS previous_class, lag(lines) OVER w AS previous_lines FROM (SELECT *, {_GRADE} AS abc_class FROM ranked) WINDOW w AS (PARTITION BY sku ORDER BY period))
SELECT period, sku, previous_class, abc_class, previous_class || ' -> ' || abc_class AS change, previous_lines::BIGINT AS previous_lines, lines::BIGINT AS lines, (lines - previous_lines)::BIGINT AS delta_lines, stock FROM l WHERE previous_class IS NOT NULL""",
    "abc_monthly_activity": f"WITH {CTES} SELECT sku, strftime(operational_date, '%Y-%m') AS period, count(*) AS lines, sum(quantity) AS units FROM movements WHERE movement_type = 'PI' GROUP BY ALL",
    "abc_temporality": f"""{_YTD(True)}, m AS (SELECT sku, strftime(operational_date, '%Y-%m') AS mo, count(*) AS n FROM pi GROUP BY ALL),
sp AS (SELECT sku, count(*) AS months, avg(n) AS mean_lines, stddev_samp(n) AS std_lines, max(n) AS max_lines FROM m GROUP BY sku),
j AS (SELECT sku, {_GRADE} AS abc_class, lines::BIGINT AS lines, stock, date_diff('day', last_pick, DATE '{SNAPSHOT}')::INT AS days_since_pick, coalesce(months, 0) AS months, mean_lines, std_lines, max_lines, coalesce(std_lines, 0) / nullif(mean_lines, 0) AS cv FROM ranked LEFT JOIN sp USING (sku)),
q AS (SELECT *, CASE WHEN coalesce(max_lines, 0) > 4 * coalesce(mean_lines, 0) THEN 'seasonal' WHEN coalesce(cv, 0) > 1.5 THEN 'intermittent' WHEN coalesce(days_since_pick, 9999) > 180 THEN 'dormant' WHEN months < 3 THEN 'new' ELSE 'regular' END AS pattern FROM j),
d AS (SELECT *, CASE WHEN pattern = 'intermittent' AND stock > 0 THEN 'manual review' WHEN pattern IN ('dormant', 'seasonal') AND stock > 0 THEN 'move off season' WHEN abc_class = 'C' AND stock > 0 THEN 'review for secondary store' ELSE 'keep accessible' END AS decision FROM q)
SELECT sku, abc_class, lines, stock, days_since_pick, months::BIGINT AS months, round(mean_lines, 6) AS mean_lines, round(std_lines, 6) AS std_lines, max_lines::BIGINT AS max_lines, round(cv, 6) AS cv_lines, pattern, decision,
  decision IN ('review for secondary store', 'move off season') AS may_move, decision = 'keep accessible' AS may_keep FROM d""",
    "abc_class_summary": f"""{_YTD(False)}, {_ROLL}, ranked2 AS ({_rank_sql('roll', ['sku'])}),
u AS (SELECT 'owner_ytd' AS dataset, {_GRADE} AS abc_class, sku, lines, units, stock FROM ranked UNION ALL SELECT 'article_ytd', {_GRADE}, sku, lines, units, stock FROM ranked2)
SELECT abc_class, count(DISTINCT sku)::BIGINT AS items, sum(lines)::BIGINT AS lines, sum(units) AS units, sum(stock) AS stock, dataset FROM u GROUP BY dataset, abc_class""",
    "abc_kpis": f"""{_YTD(True)}, g AS (SELECT *, {_GRADE} AS c FROM ranked)
SELECT count(*) AS items, sum(lines)::BIGINT AS lines, count(*) FILTER (c = 'A') AS class_a, count(*) FILTER (c = 'B') AS class_b, count(*) FILTER (c = 'C') AS class_c, count(*) FILTER (c = 'D') AS class_d,
  (SELECT count(*) FROM agg) AS owner_items, (SELECT sum(stock_quantity) FROM stock) AS stock_total FROM g""",
}
ORACLES["abc_decision_counts"] = f"""WITH t AS ({ORACLES["abc_temporality"]}) SELECT 'pattern' AS section, pattern AS key, count(*) AS items FROM t GROUP BY 2 UNION ALL SELECT 'decision', decision, count(*) FROM t GROUP BY 2
UNION ALL SELECT 'flag', 'may_move', count(*) FILTER (may_move) FROM t UNION ALL SELECT 'flag', 'may_keep', count(*) FILTER (may_keep) FROM t"""

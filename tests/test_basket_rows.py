"""Baskets stored as rows: the same periods and pairs as from item rows, with fewer shuffles."""

import datetime as dt
import re

from pyspark.sql import functions as F

from depotlane.operators import basket
from depotlane.plans import basket as plans

DAYS = {"t1": "2001-06-30", "t2": "2001-05-02", "t3": "2000-09-01", "t4": "1999-02-03", "t5": None, "t6": "1998-01-01"}
ROWS = [(t, a, float(k + 1), DAYS[t] and dt.datetime.fromisoformat(DAYS[t])) for t, items in {"t1": "abc", "t2": "ab", "t3": "ac", "t4": "bcd", "t5": "ab", "t6": "d"}.items() for k, a in enumerate(items)]
ROWS[1] = ("t1", "b", 9.0, dt.datetime(2001, 1, 15))  # a row of t1 in another quarter
ROWS += [("t7", "c", 1.0, dt.datetime(1997, 5, 1)), ("t7", "c", 2.0, dt.datetime(1997, 5, 2)), ("t8", "c", 1.0, dt.datetime(1997, 5, 3))]  # an item twice under one id: no pair


def table(spark):
    return spark.createDataFrame(ROWS, "transaction_id string, article string, quantity_sum double, last_completion_date timestamp")


def rows(df, *columns):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*(columns or sorted(df.columns))).collect())


def exchanges(df, key):
    return len(re.findall(rf"Exchange hashpartitioning\({key}", df._jdf.queryExecution().executedPlan().toString()))


def test_periods_of_whole_baskets(spark):
    baskets = basket.whole_baskets(table(spark)).localCheckpoint()
    assert baskets.count() == 8 and basket.basket_rows(baskets).count() == len(ROWS)
    made, wanted = basket.basket_totals(baskets), basket.period_totals(basket.dated(table(spark)))
    assert rows(made) == rows(wanted)
    assert {r.label: r.paired for r in made.collect()}["quarter_1997Q2"] is False
    assert "hashpartitioning(transaction_id" not in made._jdf.queryExecution().executedPlan().toString()


def test_pairs_dealt_once_for_stability(spark):
    totals = basket.with_period_start(basket.period_totals(basket.dated(table(spark))), "2001-06-30", "label")
    once, twice = (basket.temporal_pairs(table(spark), totals=totals, by_pair=b) for b in (True, False))
    assert rows(once) == rows(twice)
    available = totals.agg(F.count_if("paired").alias("available"))
    steady = basket.stability(once, available)
    assert rows(steady) == rows(basket.stability(twice)) and steady.count() == 5
    assert exchanges(steady.select(*basket.PAIR, "support_trend"), "article_a") == 1


def test_stability_query_shuffles_lines_and_pairs_once(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plans.basket_stability(spark, "/root/testdata/sf0.001")
        assert exchanges(plan, "article_a") == 1 and exchanges(plan, r"article#\d+, \d+") == 2 and exchanges(plan, "transaction_id") == 2  # of two equal sides each, of which one is reused
        assert plan.where(F.col("presence_ratio") > 1).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_series_from_stored_baskets(spark):
    lines = spark.createDataFrame([(t, t[1:], "o", a, f"ITEM {a}", None if a == "b" else "L1", q, day) for t, a, q, day in ROWS if t != "t7"] + [("t9", "9", "o", "a", None, "L2", 2.0, None)] * 2, "transaction_id string, external_order_id string, owner string, article string, sku_description string, location string, quantity double, completion_date timestamp")
    baskets = basket.whole_baskets(basket.transaction_items(lines)).localCheckpoint()
    assert rows(basket.describe(basket.basket_figures(baskets)), "section", "key", "metric", "value") == rows(basket.describe(basket.transactions(lines)), "section", "key", "metric", "value")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plans.basket_series(spark, "/root/testdata/sf0.001")
        assert exchanges(plan, "l_orderkey") == 0 and exchanges(plan, "transaction_id") == 2  # the two sides of pairs
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

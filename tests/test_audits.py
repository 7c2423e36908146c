"""Versions of requests, audits with bounded lists, and snapshots chosen by name."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from depotlane.functions.text import day_first
from depotlane.operators import basket, facts, quality
from depotlane.sources import files

DAY = date(2024, 1, 1)


def made(rng, n=400):
    rows = []
    for _ in range(n):
        stamp = lambda: None if rng.random() < 0.4 else datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(5))
        field, rank, fallback = rng.choice([("service_date", 1, False), ("event_start", 2, True), ("event_end", 3, True), ("<MISSING>", 999, False)])
        when = None if rank == 999 else DAY + timedelta(days=rng.randrange(3))
        rows.append((f"c{rng.randrange(40)}", f"s{rng.randrange(4)}", 1.0, DAY, when, rng.choice(["SGE", "EGE"]), rng.choice(["delivery", "pickup"]), field, rank, fallback, stamp(), stamp(), stamp()))
    return rows


COLUMNS = "generic_code string, sku string, requested_quantity double, created_date date, date date, service_type string, service_class string, field string, rank int, fallback boolean, modified_at timestamp, line_modified_at timestamp, order_created_at timestamp"


def test_latest_version_by_the_greatest_timestamp(spark):
    rows = made(random.Random(6)) + [("alone", "s", 1.0, DAY, None, "SGE", "delivery", "<MISSING>", 999, False, None, None, None)]
    items = spark.createDataFrame([("s1", 2.0, 0.5)], "sku string, kilos double, m3 double")
    versions = ("modified_at", "line_modified_at", "order_created_at", "absent")
    got = {r.generic_code: r for r in facts.request_level(spark.createDataFrame(rows, COLUMNS), items, versions).collect()}
    assert "alone" not in got
    old = datetime(1900, 1, 1)
    for code in {r[0] for r in rows} - {"alone"}:
        own = [r for r in rows if r[0] == code and r[4]]
        best = min(own, key=lambda r: (r[8], -(max([t for t in r[10:13] if t] or [old]) - old).total_seconds(), -r[4].toordinal(), r[5], r[6], r[7]))
        have = got[code]
        assert (have.date, have.service_type, have.service_class, have.field, have.fallback) == (best[4], best[5], best[6], best[7], best[9]), code
        assert (have["lines"], have["items"], have.kg) == (len(own), len({r[1] for r in own}), 2.0 * sum(r[1] == "s1" for r in own))
    far = [("x", "s", 1.0, DAY, date(2300, 5, 6), "SGE", "delivery", "service_date", 1, False, datetime(2299, 1, 1), None, None), ("y", "s", 1.0, DAY, date(1850, 5, 6), "SGE", "delivery", "service_date", 1, False, None, None, None)]
    assert {r.generic_code: r.date for r in facts.request_level(spark.createDataFrame(far, COLUMNS), items, versions).collect()} == {"x": date(2300, 5, 6), "y": date(1850, 5, 6)}


def test_moved_dates(spark):
    rows = [("a", DAY, 1), ("a", DAY + timedelta(days=9), 2), ("a", DAY + timedelta(days=4), 3), ("b", DAY, 5), ("b", DAY + timedelta(days=2), 1), ("c", DAY, 1), ("c", DAY, 2), ("d", None, 1)]
    df = spark.createDataFrame([(c, d, datetime(2024, 2, v)) for c, d, v in rows], "code string, d date, v timestamp")
    r = quality.several_dates(df, "code", "d", F.col("v")).first()
    assert (r.codes, r.with_several, round(r.share, 6), r.moved_share, r.median_shift, r.max_shift) == (3, 2, 0.666667, 0.5, 2.0, 4)
    top = quality.most_moved(df, "code", "d", F.col("v"), 5).collect()
    assert [(x.code, x.dates, x["shift"], x.latest) for x in top] == [("a", 3, 4, DAY + timedelta(days=4)), ("b", 2, 0, DAY)]
    assert [x.code for x in quality.most_moved(df, "code", "d", F.col("v"), 1).collect()] == ["a"]


def test_class_examples_and_unknown_concepts(spark):
    rows = [("UNK", f"c{k:02d}", f"word {k % 3}") for k in range(20)] + [("delivery", "z", None), ("UNK", "c99", None)]
    df = spark.createDataFrame(rows, "service_class string, service_code string, concept string")
    got = {r.service_class: (r.rows, r.examples, round(r.share, 4)) for r in quality.classification_qa(df, n=3).collect()}
    assert got == {"UNK": (21, "c00,c01,c02", 0.9545), "delivery": (1, "z", 0.0455)}
    top = quality.unknown_concepts(df, n=3).collect()
    assert [(r.concept, r.rows) for r in top] == [("word 0", 7), ("word 1", 7), ("word 2", 6)] and round(top[0].unknown_pct, 4) == 0.9545
    assert quality.unknown_concepts(df.limit(0)).count() == 0
    ranks = quality.classification_qa(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in ranks  # rows beyond the limit are dropped before the shuffle


def test_reference_audits(spark):
    compared = spark.createDataFrame([(DAY, "lines", 5.0), (date(2024, 4, 2), "lines", None), (DAY, "units", None)], "date date, kpi string, reference double")
    got = {r.kpi: (r.rows, r.known, r.missing, r.missing_pct, r.total, r.status) for r in quality.reference_coverage(compared, ["lines", "units", "none"]).collect()}
    assert got == {"lines": (2, 1, 1, 0.5, 5.0, "ok"), "units": (1, 0, 1, 1.0, None, "error"), "none": (0, 0, 0, 0.0, None, "error")}
    forecasts = spark.createDataFrame([(DAY, "lines", 2.0), (DAY, "other", 9.0), (date(2024, 5, 2), "lines", 3.0)], "date date, kpi string, forecast_value double")
    got = {(r.kpi, r.quarter): (r.forecast_rows, r.forecast_sum, r.reference_rows, r.reference_known, r.reference_sum, r.status) for r in quality.reference_alignment(forecasts, compared, ["lines", "units"]).collect()}
    assert got == {("lines", 1): (1, 2.0, 1, 1, 5.0, "ok"), ("units", 1): (0, 0.0, 1, 0, 0.0, "error"), ("lines", 2): (1, 3.0, 1, 0, 0.0, "error"), ("units", 2): (0, 0.0, 0, 0, 0.0, "error")}


def test_item_tables(spark):
    rows = [("t1|x", "x", "a", 2.0, 1), ("t2|x", "x", "a", 4.0, 3), ("t1|y", "y", "a", 6.0, 2), ("t1|y", "y", "b", 1.0, 2)]
    items = spark.createDataFrame([(t, o, a, q, datetime(2024, 1, d)) for t, o, a, q, d in rows], "transaction_id string, owner string, article string, quantity_sum double, last_completion_date timestamp")
    per = basket.owner_items(items)
    assert {(r.owner, r.article): (r.transaction_frequency, r.total_quantity) for r in per.collect()} == {("x", "a"): (2, 6.0), ("y", "a"): (1, 6.0), ("y", "b"): (1, 1.0)}
    a = {r.article: r for r in basket.item_summary(per).collect()}["a"]
    assert (a.transaction_frequency, a.row_frequency, a.owner_count, a.mean_quantity, a.first_seen.day, a.last_seen.day) == (3, 3, 2, 4.0, 1, 3)


def test_described_periods_keep_null(spark):
    txs = spark.createDataFrame([(2, 3.0, 2024, "2024Q1", "2024-01"), (1, 1.0, None, None, None)], "basket_size long, total_quantity double, year int, quarter string, month string")
    got = {(r.section, r.key): r.value for r in basket.describe(txs).where("metric = 'transactions'").collect()}
    assert got == {("overall", "all"): 2, ("year", "2024"): 1, ("year", None): 1, ("quarter", "2024Q1"): 1, ("quarter", None): 1, ("month", "2024-01"): 1, ("month", None): 1, ("basket_size", "1"): 1, ("basket_size", "2"): 1}


def test_snapshot_is_chosen_by_name(spark, tmp_path):
    for name in ("stock 01-02-2023.csv", "stock 28-01-2024.csv", "stock.csv", "stock 99-99-2025.csv"):
        (tmp_path / name).write_text("a,b\n1,2\n")
    got = files.latest_snapshot(spark, str(tmp_path / "*.csv"))
    assert [f.rsplit("/", 1)[-1] for f in got.inputFiles()] == ["stock%2028-01-2024.csv"]  # no other file is opened
    assert got.collect()[0].asDict() == {"a": "1", "b": "2", "snapshot_date": date(2024, 1, 28)}
    none = files.latest_snapshot(spark, str(tmp_path / "stock.csv"))
    assert none.count() == 0 and none.columns == ["a", "b", "snapshot_date"]


def test_stages_and_movement_report(spark):
    rows = [("PI", "K", 2.0, "01/02/2024"), ("PI", None, 0.0, "31/02/2024"), ("CR", "K", None, " "), (None, None, 1.0, None)]
    df = spark.createDataFrame(rows, "movement_type string, external_order_id string, quantity double, ended string").withColumn("operational_date", F.to_date(F.lit("2024-01-01")))
    got = {r.stage: r.rows for r in quality.stages(df, {"picks": F.col("movement_type") == "PI", "quantity": F.col("quantity") > 0}).collect()}
    assert got == {"all": 4, "picks": 2, "quantity": 1}
    report = {(r.section, r.key): r.value for r in quality.movement_qa(df, {"ended": day_first(F.col("ended"))}).collect()}
    assert report["overall", "unreadable_ended"] == 1 and report["overall", "missing_quantity_pct"] == 0.25 and report["overall", "picks_without_order_pct"] == 0.5
    assert (report["type", "PI"], report["type", "<EMPTY>"], report["overall", "picks"]) == (2, 1, 2)
    none = {r.key: r.value for r in quality.movement_qa(df.limit(0), {}).collect()}
    assert none["rows"] == 0 and none["picks_without_order_pct"] == 1.0


def test_unmatched_side_by_side(spark):
    left = spark.createDataFrame([("a", False), ("a", False), (None, False), ("m", True)], "k string, has boolean")
    right = spark.createDataFrame([("a", False), ("b", False), ("m", True)], "c string, has boolean")
    got = {r.value: (r.left, r.right) for r in quality.unmatched_aligned(left, "k", right, "c", "has").collect()}
    assert got == {"a": (2, 1), "<NULL>": (1, 0), "b": (0, 1)}


def test_service_actuals_around_the_switch(spark):
    rows = [(DAY, "notes", "final", 2), (DAY + timedelta(days=2), "requests", "visible", 3), (DAY + timedelta(days=4), "requests", "visible", 4)]
    fact = spark.createDataFrame(rows, "date date, source string, truth string, deliveries_sge long")
    got = [(r.date.day, r.actual_value, r.actual_source, r.actual_truth) for r in facts.service_actuals(fact, {"sge": "deliveries_sge"}).orderBy("date").collect()]
    assert got == [(1, 2.0, "notes", "final"), (2, 0.0, "notes", "final"), (3, 3.0, "requests", "visible"), (4, 0.0, "requests", "visible"), (5, 4.0, "requests", "visible")]
    early = facts.service_actuals(fact.where("source = 'notes'"), {"sge": "deliveries_sge"}).collect()
    assert [(r.actual_source, r.actual_truth) for r in early] == [("notes", "final")]


def test_delta_ranges(spark):
    before = spark.createDataFrame([(DAY, "k", 0.0), (DAY + timedelta(days=1), "k", 2.0)], "date date, kpi string, value double")
    after = spark.createDataFrame([(DAY, "k", 1.0)], "date date, kpi string, value double")
    r = quality.delta_report(before, after, ["date", "kpi"], "value", "kpi", "date").first()
    assert (r.before, r.after, r.net_delta, r.absolute_delta, r.changed_rows, r.nonzero_before, r.nonzero_after) == (2.0, 1.0, -1.0, 3.0, 2, 1, 1)
    assert (r.first_before, r.first_after, r.last_before, r.last_after) == (DAY + timedelta(days=1), DAY, DAY + timedelta(days=1), DAY)

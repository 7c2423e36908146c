"""Weekly consumption, totals and checks over small tables."""

from datetime import date, datetime

from pyspark.sql import functions as F

from depotlane.operators import abc, calendar, facts, tracking

RUN = datetime(2024, 1, 10, 6)  # a Wednesday


def history(spark):
    rows = [("r1", RUN, date(2024, 1, 10), date(2024, 1, d), k, "m", v) for d, k, v in ((11, "a", 1.0), (14, "a", 2.0), (15, "a", 4.0), (22, "a", 8.0), (15, "b", 3.0))]
    rows.append(("r0", datetime(2024, 1, 9), date(2024, 1, 9), date(2024, 1, 11), "a", "m", 100.0))
    return spark.createDataFrame(rows, "run_id string, run_ts timestamp, run_date date, target_date date, kpi string, model string, forecast_value double")


def test_weekly_consumption(spark):
    weeks = spark.createDataFrame([(date(2024, 1, 15), "a", 9.0, "notes", "final")], "week date, kpi string, actual_value double, actual_source string, actual_truth string")
    got = {(r.kpi, r.week.day): (r.forecast_value, r.days, r.horizon_weeks, r.bucket, r.source, r.actual_value) for r in tracking.consumption_weekly(history(spark), ["a", "b"], weeks).collect()}
    assert got == {
        ("a", 8): (3.0, 2, 0, None, "daily_aggregated", None), ("a", 15): (4.0, 1, 1, "W+1", "daily_aggregated", 9.0), ("a", 22): (8.0, 1, 2, "W+2", "daily_aggregated", None), ("b", 15): (3.0, 1, 1, "W+1", "daily_aggregated", None),
    }


def test_reconciled(spark):
    daily = spark.createDataFrame([(date(2024, 1, 14), "a", 1.0), (date(2024, 1, 15), "a", 2.0), (date(2024, 1, 15), "b", 4.0)], "date date, kpi string, forecast double")
    days, weeks = tracking.reconciled(daily, {"both": ["a", "b"]})
    assert {(r.date.day, r.kpi): r.forecast for r in days.collect()} == {(14, "a"): 1.0, (15, "a"): 2.0, (15, "b"): 4.0, (14, "both"): 1.0, (15, "both"): 6.0}
    assert {(r.week.day, r.kpi): r.forecast for r in weeks.collect()} == {(8, "a"): 1.0, (15, "a"): 2.0, (15, "b"): 4.0, (8, "both"): 1.0, (15, "both"): 6.0}


def test_mondays_of_a_year(spark):
    got = sorted(r.date for r in tracking.full_year(spark, 2026, ["a"], weekly=True).collect())
    assert (got[0], got[-1], len(got)) == (date(2026, 1, 5), date(2026, 12, 28), 52)  # the week of 1 January began in 2025


def checks(spark, daily, weekly, compared, progressed, actuals, kpis=("a", "b")):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    years = df(compared, "date date, kpi string, reference_date date, reference double")
    out = tracking.validations(
        df(daily, "date date, kpi string"), df(weekly, "date date, kpi string, source string"), years, years, df([(k,) for k in range(progressed)], "x int"), df(actuals, "date date, kpi string"),
        df([(k,) for k in kpis], "kpi string"), ["a", "b"], 2020,
    )
    return {(r.check, r.kpi): (r.value, r.status) for r in out.collect()}


def test_checks(spark):
    d, r = date(2024, 1, 1), date(2020, 1, 1)
    fine = checks(spark, [(d, "a"), (d, "b")], [(d, "a", "daily_aggregated")], [(d, "a", r, 1.0), (d, "b", r, 2.0)], 6, [(r, "a"), (r, "b")])
    assert len(fine) == 18 and {s for _, s in fine.values()} == {"ok"}
    bad = checks(spark, [(d, "a"), (d, "a"), (date(2024, 1, 2), "a"), (d, "c")], [(d, "a", "hand"), (d, "b", None)], [(d, "a", r, None), (d, "b", r, 2.0), (date(2024, 2, 29), "b", None, None)], 5, [(r, "a"), (date(2021, 1, 1), "b")], ("a",))
    assert bad["daily_kpis", "all"] == (2.0, "warning") and bad["dimension_kpis", "all"] == (1.0, "warning")  # b isn't shown, c isn't known
    assert bad["weekly_source", "all"] == (2.0, "error") and bad["progress_rows", "all"] == (5.0, "warning")
    assert bad["daily_duplicates", "all"] == (1.0, "error") and bad["weekly_duplicates", "all"] == (0.0, "ok")
    assert bad["daily_forecast_without_row", "a"] == (1.0, "error") and bad["daily_forecast_without_row", "b"] == (0.0, "ok")
    assert bad["daily_coverage", "all"][1] == "warning"
    assert bad["daily_reference", "a"] == (0.0, "error")  # there is a source, but no reference
    assert bad["daily_reference", "b"] == (1.0, "warning")  # nothing in the reference year to compare with


def test_cards_and_points(spark):
    compared = spark.createDataFrame([(date(2024, 1, 2), "a", 4.0, 8.0), (date(2024, 5, 2), "a", 1.0, 1.0), (date(2023, 1, 2), "a", 99.0, 99.0), (date(2024, 1, 3), "b", None, None), (date(2024, 1, 2), "x", 7.0, 7.0)], "date date, kpi string, actual double, reference double")
    forecasts = spark.createDataFrame([(date(2024, 1, 2), "a", 5.0), (date(2024, 1, 4), "b", 3.0)], "date date, kpi string, forecast_value double")
    points = facts.group_points(forecasts, compared, {"a": "first", "b": "second"}, [1])
    assert {(r.date.day, r.group): (r.actual, r.forecast, r.reference) for r in points.collect()} == {(2, "first"): (4.0, 5.0, 8.0), (4, "second"): (None, 3.0, None)}
    got = {r.group: tuple(r)[1:] for r in facts.cards(points, ["first", "second", "third"]).collect()}
    assert got["first"] == (4.0, 5.0, 8.0, 4.0, "actual", -0.2, -0.5) and got["second"] == (None, 3.0, None, 3.0, "forecast", None, None) and got["third"] == (None, None, None, None, "none", None, None)


def test_decision_counts(spark):
    rows = [("regular", "keep accessible", False, True), ("regular", "move off season", True, False), ("new", "keep accessible", False, True)]
    got = {(r.section, r.key): r["items"] for r in abc.decision_counts(spark.createDataFrame(rows, "pattern string, decision string, may_move boolean, may_keep boolean")).collect()}
    assert got == {("pattern", "regular"): 2, ("pattern", "new"): 1, ("decision", "keep accessible"): 2, ("decision", "move off season"): 1, ("flag", "may_move"): 1, ("flag", "may_keep"): 2}


def test_stamp_of_many_runs_and_ties(spark):
    rows = spark.createDataFrame([(date(2024, 1, 2), date(2024, 1, 3), "a", 1.0, "m"), (date(2024, 1, 9), date(2024, 1, 10), "a", 2.0, "m")], "origin date, target_date date, kpi string, forecast_value double, model string")
    out = tracking.stamp(rows, F.col("origin").cast("timestamp"), F.concat(F.lit("r"), F.day("origin").cast("string")), "2024-01-05")
    assert {(r.run_id, str(r.run_date), r.source) for r in out.collect()} == {("r2", "2024-01-02", "notes"), ("r9", "2024-01-09", "requests")}
    again = out.withColumn("forecast_value", F.col("forecast_value") + 5)  # arrived at the same time
    one = {tuple(r) for r in tracking.append_history(out, out.unionByName(again)).collect()}
    other = {tuple(r) for r in tracking.append_history(out, again.unionByName(out).repartition(3)).collect()}
    assert one == other and len(one) == 2


def test_labels_of_series(spark):
    series = spark.createDataFrame([("a", date(2024, 1, 2), 1.0), ("b", date(2024, 1, 3), 1.0)], "series string, date date, target double")
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3)], "date date")
    switch = spark.createDataFrame([("a", date(2024, 1, 2))], "series string, date date")
    got = {(r.series, r.date.day): (r.target, r.is_actual, r.source, r.truth, r.is_final) for r in calendar.assemble(series, days, switch=switch).collect()}
    assert got["a", 1] == (0.0, False, "notes", "final", 1) and got["a", 2] == (1.0, True, "requests", "visible", 0) and got["b", 3] == (1.0, True, "notes", "final", 1)
    assert "source" not in calendar.assemble(series, days).columns

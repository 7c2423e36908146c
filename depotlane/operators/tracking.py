"""Forecast history, tracking against actuals, and consumption tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from depotlane.functions.text import monday, monday_of_iso, same_day_in, weekly_bucket

HISTORY_KEY = ("run_id", "target_date", "kpi", "model", "source", "frequency")


def stamp(forecasts: DataFrame, run_ts: str | Column, run_id: str | Column, switch_date: str, version: str = "v1", frequency: str = "daily") -> DataFrame:
    """Forecast rows with run, source context (by switch date) and version, ready for the history.

    Run time and id are given for all rows, or as columns for rows of many runs.
    """
    ts = (F.lit(run_ts) if isinstance(run_ts, str) else run_ts).cast("timestamp")
    return forecasts.withColumns({
        "run_ts": ts, "run_date": F.to_date(ts), "run_id": F.lit(run_id) if isinstance(run_id, str) else run_id, "version": F.lit(version), "frequency": F.lit(frequency),
        "source": F.when(F.col("target_date") < F.lit(switch_date).cast("date"), "notes").otherwise("requests"),
    })


def append_history(history: DataFrame, rows: DataFrame, arrived: str = "run_ts", key: Sequence[str] = HISTORY_KEY) -> DataFrame:
    """History with new rows, the last version of each key kept; columns that one side lacks are null.

    Of versions that arrived together, the one with the greatest hash of all its columns stays, whatever the order of rows.
    """
    both = history.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_new").desc(), F.col(arrived).desc_nulls_last(), F.xxhash64(*[c for c in both.columns if c != "_new"]).desc()))
    return both.withColumn("_k", last).where("_k = 1").drop("_k", "_new")


def weekly_history(daily: DataFrame) -> DataFrame:
    """Weekly rows of each run from its daily ones."""
    return daily.groupBy("run_id", "run_ts", "run_date", "kpi", "model", monday(F.col("target_date")).alias("week")).agg(F.sum("forecast_value").alias("forecast_value"), F.count("*").alias("days"))


def against_actuals(history: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecasts with actuals: errors, percentage error (null at 0) and horizon in days."""
    out = history.join(actuals.select("kpi", F.col("date").alias("target_date"), "actual_value"), ["kpi", "target_date"], "left")
    e = F.col("forecast_value") - F.col("actual_value")
    return out.withColumns({"error": e, "abs_error": F.abs(e), "ape": F.try_divide(F.abs(e), F.abs("actual_value")), "horizon": F.datediff("target_date", "run_date")})


def latest_run(history: DataFrame) -> DataFrame:
    """Rows of the run with the greatest time, then id."""
    last = history.agg(F.max(F.struct("run_ts", "run_id")).alias("m")).select("m.run_id")
    return history.join(F.broadcast(last), "run_id")  # one row


def consumption(history: DataFrame, kpis: Sequence[str], date: str = "target_date") -> DataFrame:
    """One row for each date and KPI of the latest run."""
    own = latest_run(history).where(F.col("kpi").isin(*kpis))
    last = F.row_number().over(Window.partitionBy(date, "kpi").orderBy(F.col("run_ts").desc(), F.col("model").desc()))
    return own.withColumn("_k", last).where("_k = 1").drop("_k")


def consumption_weekly(history: DataFrame, kpis: Sequence[str], actuals_weekly: DataFrame, source: str = "daily_aggregated") -> DataFrame:
    """One row for each week and KPI of the latest run: its days' sum, horizon in whole weeks with its bucket, and the week's actual.

    actuals_weekly: week, kpi, actual_value, actual_source, actual_truth.
    """
    weeks = weekly_history(consumption(history, kpis)).withColumn("horizon_weeks", (F.datediff("week", monday(F.col("run_date"))) / 7).cast("int"))
    out = weeks.withColumns({"bucket": weekly_bucket(F.col("horizon_weeks")), "source": F.lit(source)})
    known = actuals_weekly.select("week", "kpi", "actual_value", "actual_source", "actual_truth")
    return out.select("run_id", "week", "kpi", "forecast_value", "days", "horizon_weeks", "bucket", "source").join(known, ["week", "kpi"], "left")


def reconciled(daily: DataFrame, totals: dict[str, Sequence[str]], by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(daily, weekly) forecasts (by, date, kpi, forecast) with totals of KPIs as further KPIs, weeks being sums of days."""
    out = daily.select(*by, "date", "kpi", "forecast")
    for name, parts in totals.items():
        total = daily.where(F.col("kpi").isin(*parts)).groupBy(*by, "date").agg(F.sum("forecast").alias("forecast"))
        out = out.unionByName(total.withColumn("kpi", F.lit(name)))
    return out, out.groupBy(*by, monday(F.col("date")).alias("week"), "kpi").agg(F.sum("forecast").alias("forecast"))


def full_year(spark: SparkSession, year: int, kpis: Sequence[str], weekly: bool = False) -> DataFrame:
    """Every day (or Monday that lies in the year) with every KPI."""
    step = "interval 7 days" if weekly else "interval 1 day"
    start = f"next_day(date'{year - 1}-12-31', 'MO')" if weekly else f"date'{year}-01-01'"
    days = spark.sql(f"select explode(sequence(cast({start} as date), date'{year}-12-31', {step})) as date")
    return days.withColumn("kpi", F.explode(F.array(*[F.lit(k) for k in kpis])))


def _compared(out: DataFrame) -> DataFrame:
    return out.withColumns({"diff": F.col("actual") - F.col("reference"), "diff_pct": F.try_divide(F.col("actual") - F.col("reference"), F.col("reference"))})


def year_on_year_daily(base: DataFrame, actuals: DataFrame, forecasts: DataFrame, reference_year: int) -> DataFrame:
    """Each day with its actual, its forecast and the same calendar day of the reference year."""
    a = actuals.select("date", "kpi", F.col("actual_value").alias("actual"))
    out = base.join(a, ["date", "kpi"], "left").join(forecasts.select("date", "kpi", F.col("forecast_value").alias("forecast")), ["date", "kpi"], "left")
    out = out.withColumn("reference_date", same_day_in(F.col("date"), reference_year))
    return _compared(out.join(a.toDF("reference_date", "kpi", "reference"), ["reference_date", "kpi"], "left"))


def year_on_year_weekly(base: DataFrame, actuals_weekly: DataFrame, reference_year: int, forecasts: DataFrame | None = None) -> DataFrame:
    """Each week with its actual, its forecast (week, kpi, forecast_value, if given) and the same ISO week of the reference year."""
    a = actuals_weekly.select(F.col("week").alias("date"), "kpi", F.col("actual_value").alias("actual"))
    out = base.join(a, ["date", "kpi"], "left")
    if forecasts is not None:
        out = out.join(forecasts.select(F.col("week").alias("date"), "kpi", F.col("forecast_value").alias("forecast")), ["date", "kpi"], "left")
    out = out.withColumn("reference_date", monday_of_iso(F.lit(reference_year), F.weekofyear("date")))
    return _compared(out.join(a.toDF("reference_date", "kpi", "reference"), ["reference_date", "kpi"], "left"))


def progress(spark: SparkSession, run_date: str, kpis: Sequence[str], plan: DataFrame, remaining: DataFrame, actuals: DataFrame, reference_year: int) -> DataFrame:
    """Day, week and month up to the run date for each KPI: plan, actual, rest of the forecast and the reference year.

    plan: as-of forecasts (date, kpi, forecast_value) made before each date. Where they cover
    every elapsed day, plan and rest are the period's forecast, else actuals and rest.
    """
    run = F.lit(run_date).cast("date")
    last_day = F.last_day(run)
    shape = lambda name, a, b: F.struct(F.lit(name).alias("period"), a.alias("start"), b.alias("end"))
    periods = spark.range(1).select(F.explode(F.array(shape("day", run, run), shape("week", monday(run), F.date_add(monday(run), 6)), shape("month", F.date_trunc("month", run).cast("date"), last_day))).alias("p")).select("p.*")
    periods = periods.withColumn("kpi", F.explode(F.array(*[F.lit(k) for k in kpis])))
    days = periods.withColumn("date", F.explode(F.sequence("start", "end")))
    reference = F.when(F.col("period") == "week", F.date_add(monday_of_iso(F.lit(reference_year), F.weekofyear(run)), F.weekday("date"))).otherwise(same_day_in(F.col("date"), reference_year))
    days = days.withColumns({"elapsed": F.col("date") <= run, "reference_date": reference})
    a = actuals.select("date", "kpi", F.col("actual_value").alias("actual"))
    out = days.join(plan.select("date", "kpi", F.col("forecast_value").alias("planned")), ["date", "kpi"], "left").join(a, ["date", "kpi"], "left")
    out = out.join(remaining.select("date", "kpi", F.col("forecast_value").alias("rest")), ["date", "kpi"], "left").join(a.toDF("reference_date", "kpi", "before"), ["reference_date", "kpi"], "left")
    till = lambda c: F.sum(F.when(F.col("elapsed"), F.col(c)))
    out = out.groupBy("period", "start", "end", "kpi").agg(
        F.count_if("elapsed").alias("expected_days"), F.count_if(F.col("elapsed") & F.col("planned").isNotNull()).alias("planned_days"), till("planned").alias("plan"), till("actual").alias("actual"),
        F.coalesce(F.sum(F.when(~F.col("elapsed"), F.col("rest"))), F.lit(0.0)).alias("rest"), till("before").alias("reference"),
    )
    covered = F.col("planned_days") == F.col("expected_days")
    out = out.withColumn("plan", F.when(covered, F.col("plan")))
    return out.withColumns({
        "total": F.coalesce(F.when(covered, F.col("plan")).otherwise(F.col("actual")), F.lit(0.0)) + F.col("rest"), "method": F.when(covered, "plan and rest").otherwise("actual and rest"),
        "gap": F.col("actual") - F.col("plan"), "fulfilled": F.try_divide(F.col("actual"), F.col("plan")), "diff": F.col("actual") - F.col("reference"), "diff_pct": F.try_divide(F.col("actual") - F.col("reference"), F.col("reference")),
    })


def validations(
    daily: DataFrame, weekly: DataFrame, compared_daily: DataFrame, compared_weekly: DataFrame, progressed: DataFrame, actuals: DataFrame, dimension: DataFrame, kpis: Sequence[str], reference_year: int,
    allowed: Sequence[str] = ("daily_aggregated",), enough: float = 0.95,
) -> DataFrame:
    """check, kpi ('all' for whole tables), value, status (ok, warning, error) of the consumption tables.

    daily, weekly: date, kpi (and source) of the forecasts shown; compared_*: date, kpi, reference_date, reference of
    the year-on-year tables; progressed: rows of progress; actuals: date, kpi; dimension: kpi.
    """
    spark = daily.sparkSession
    wanted = spark.createDataFrame([(k,) for k in kpis], "kpi string")
    one = lambda df, name, value, bad, worst="error": df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("check"), F.lit("all").alias("kpi"), "value", F.when(bad(F.col("value")), worst).otherwise("ok").alias("status"))
    sets = lambda df: df.select("kpi", F.lit(1).alias("has")).distinct().join(wanted.withColumn("want", F.lit(1)), "kpi", "full_outer")
    differ = F.count_if(F.col("has").isNull() | F.col("want").isNull())
    more = lambda v: v > 0
    rows = [
        one(sets(daily), "daily_kpis", differ, more, "warning"), one(sets(dimension), "dimension_kpis", differ, more, "warning"),
        one(weekly, "weekly_source", F.count_if(unknown_source(weekly, allowed)), more), one(progressed, "progress_rows", F.count("*"), lambda v: v != len(kpis) * 3, "warning"),
    ]
    for name, shown, compared in (("daily", daily, compared_daily), ("weekly", weekly, compared_weekly)):
        has = F.col("reference").isNotNull().cast("int")
        rows.append(one(compared, f"{name}_coverage", F.coalesce(F.avg(has), F.lit(0.0)), lambda v: v < enough, "warning"))
        rows.append(one(shown.groupBy("date", "kpi").count(), f"{name}_duplicates", F.coalesce(F.sum(F.col("count") - 1), F.lit(0)), more))
        lost = wanted.join(shown.select("date", "kpi").distinct().join(compared.select("date", "kpi"), ["date", "kpi"], "left_anti"), "kpi", "left").groupBy("kpi").agg(F.count("date").alias("value"))
        rows.append(one(lost, f"{name}_forecast_without_row", F.sum("value"), more))
        rows.append(lost.select(F.lit(f"{name}_forecast_without_row").alias("check"), "kpi", F.col("value").cast("double").alias("value"), F.when(F.col("value") > 0, "error").otherwise("ok").alias("status")))
        source = actuals.where(F.year("date") == reference_year).select("kpi", F.lit(True).alias("source")).distinct()
        able = F.col("reference_date").isNotNull()
        per = wanted.join(compared, "kpi", "left").groupBy("kpi").agg(F.count_if(able).alias("expected"), F.count_if(able & F.col("reference").isNotNull()).alias("known"))
        per = per.join(source, "kpi", "left").withColumn("value", F.coalesce(F.try_divide(F.col("known"), F.col("expected")), F.lit(1.0)))
        due = F.coalesce("source", F.lit(False)) & (F.col("expected") > 0)
        rows.append(per.select(F.lit(f"{name}_reference").alias("check"), "kpi", "value", F.when(~due, "warning").when(F.col("value") < 1, "error").otherwise("ok").alias("status")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def dim_kpi(spark: SparkSession, rows: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """KPI dimension: kpi, label, unit, family."""
    return spark.createDataFrame(list(rows), "kpi string, label string, unit string, family string")


def unknown_source(df: DataFrame, allowed: Sequence[str], column: str = "source") -> Column:
    """Whether a row's source is none of those allowed."""
    return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))

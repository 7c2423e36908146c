"""The date dimension, and features of daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from depotlane.functions.text import easter, monday, regime


def dim_date(spark: SparkSession, start: str, end: str, holidays: DataFrame) -> DataFrame:
    """One row per day: parts, ISO week, holiday flags and neighbours, distance from Easter.

    holidays: date, national, region, city (names, null where it is none). A bridge day is a
    working day between two days off. Neighbours are looked up by date, so no task orders all
    days.
    """
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as date")
    levels = ("national", "region", "city")
    out = days.join(F.broadcast(holidays.dropDuplicates(["date"])), "date", "left")  # some hundred days
    out = out.select("date", *[F.col(n).isNotNull().cast("int").alias(f"holiday_{n}") for n in levels])
    out = out.withColumns({
        "year": F.year("date"), "quarter": F.quarter("date"), "month": F.month("date"), "day": F.day("date"), "weekday": F.weekday("date"), "iso_week": F.weekofyear("date"), "iso_year": F.extract(F.lit("YEAROFWEEK"), "date"),
        "week_of_month": F.floor((F.day("date") - 1) / 7).cast("int") + 1, "month_end": (F.last_day("date") == F.col("date")).cast("int"), "weekend": (F.weekday("date") >= 5).cast("int"), "holiday": F.greatest(*[f"holiday_{n}" for n in levels]),
    })
    off = out.select("date", F.col("holiday").alias("h"), F.greatest("holiday", "weekend").alias("o"))
    for name, step in (("before", 1), ("after", -1)):
        near = off.select(F.date_add("date", step).alias("date"), F.col("h").alias(f"h_{name}"), F.col("o").alias(f"o_{name}"))
        out = out.join(near, "date", "left").fillna(0, [f"h_{name}", f"o_{name}"])
    free = F.greatest("holiday", "weekend")
    out = out.withColumns({"pre_holiday": F.col("h_after"), "post_holiday": F.col("h_before"), "bridge": ((free == 0) & (F.col("o_before") == 1) & (F.col("o_after") == 1)).cast("int")}).drop("h_before", "h_after", "o_before", "o_after")
    out = out.withColumn("easter_days", F.datediff("date", easter(F.col("year"))))
    return out.withColumn("easter_week", F.col("easter_days").between(1, 6).cast("int"))


def weekly_calendar(days: DataFrame) -> DataFrame:
    """Calendar features of each week: of its Monday, any, number and share of days."""
    return days.groupBy(monday(F.col("date")).alias("week")).agg(
        F.min_by("month", "date").alias("month"), F.min_by("iso_week", "date").alias("iso_week"), F.max("holiday").alias("any_holiday"), F.sum("holiday").alias("holidays"), F.sum("bridge").alias("bridges"), F.max("easter_week").alias("easter_week"), F.avg("weekend").alias("weekend_share")
    )


def assemble(series: DataFrame, calendar: DataFrame, target: str = "target", key: str = "series", switch: DataFrame | None = None) -> DataFrame:
    """Every series on every calendar day: target 0 where it has none, is_actual from its first to its last day.

    switch: key and date of the first day from another source, if any; then source and truth are labelled: notes and
    final before it (or without one), requests and visible from it on, with is_final as a number.
    """
    spans = series.groupBy(key).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"))  # one row
    grid = spans.join(F.broadcast(days), F.lit(True)).select(key, "first", "last", F.explode(F.sequence("a", "b")).alias("date"))
    out = grid.join(series.select(key, "date", target), [key, "date"], "left").fillna(0, [target])
    actual = (F.col("date") >= F.col("first")) & (F.col("date") <= F.col("last"))
    out = out.withColumns({"is_actual": actual, "regime": regime(F.col("date"))}).drop("first", "last")
    if switch is None:
        return out
    out = out.join(switch.select(key, F.col("date").alias("_switch")), key, "left")  # a row for each series
    early = F.coalesce(F.col("date") < F.col("_switch"), F.lit(True))
    return out.withColumns({"source": F.when(early, "notes").otherwise("requests"), "truth": F.when(early, "final").otherwise("visible"), "is_final": early.cast("int")}).drop("_switch")


def add_lags(df: DataFrame, lags: Sequence[int] = (7, 14, 28), windows: Sequence[int] = (7, 14, 28), target: str = "target", key: str = "series") -> DataFrame:
    """Lags, rolling means and medians of earlier rows, and the mean of the last four same weekdays."""
    own = Window.partitionBy(key).orderBy("date")
    same = Window.partitionBy(key, F.weekday("date")).orderBy("date").rowsBetween(-4, -1)
    new = {f"lag_{k}": F.lag(target, k).over(own) for k in lags}
    for w in windows:
        frame = own.rowsBetween(-w, -1)
        new |= {f"mean_{w}": F.avg(target).over(frame), f"median_{w}": F.percentile(target, F.lit(0.5)).over(frame)}
    return df.withColumns(new | {"mean_same_weekday": F.avg(target).over(same)})


def offsets_table(services: DataFrame, picks: DataFrame, most: int = 3) -> DataFrame:
    """Picks matched to services 0 to `most` days before the service date."""
    both = services.join(picks, "code").withColumn("offset", F.datediff("service_date", "pick_date"))
    return both.where(F.col("offset").between(0, most))

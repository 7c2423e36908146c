"""Histories of series addressed by date, rolling origins, and baselines on them as column expressions.

A series is one row: its first date, an array with a value for every period since, and which of these may be
learnt from. A year that training leaves out is so a hole: what looks up a date finds nothing in
it, while tails take the last usable values before it. Origins are places in the array. All
origins of a series are worked through inside its row, so no history is copied for a fold or a model; a
row has one value for each day or week of the calendar, which bounds it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from depotlane.functions.text import monday

BASELINES = ("seasonal_naive", "moving_average", "median_weekday")
#: Usable values among which the median of a weekday is taken.
MEDIAN_OF = 84


@dataclass(frozen=True)
class Frequency:
    """How far apart periods are, and what forecasts of that frequency look back on (in periods)."""

    days: int
    season: int
    window: int
    lags: tuple[int, ...]
    windows: tuple[int, ...]


DAILY = Frequency(1, 7, 7, (7, 14, 28), (7, 14, 28))
WEEKLY = Frequency(7, 52, 4, (1, 2, 4, 8), (4, 8, 12))


def weekly(daily: DataFrame, key: str = "series") -> DataFrame:
    """(series, date, target) summed by Monday."""
    return daily.groupBy(key, monday(F.col("date")).alias("date")).agg(F.sum("target").alias("target"))


def fill(series: DataFrame, frequency: Frequency = DAILY, key: str = "series") -> DataFrame:
    """Every period of each series from its first to its last: 0 where it has no row."""
    spans = series.groupBy(key).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = spans.select(key, F.explode(F.sequence("a", "b", F.expr(f"interval {frequency.days} days"))).alias("date"))
    return grid.join(series.select(key, "date", "target"), [key, "date"], "left").fillna(0.0, ["target"])


def dense(filled: DataFrame, exclude_years: Sequence[int] = (), key: str = "series") -> DataFrame:
    """One row a series: first, values (array), known (array of (i, v): the places and values to learn from).

    filled: one row for every period, none twice.
    """
    usable = ~F.year("date").isin(*exclude_years) if exclude_years else F.lit(True)
    rows = filled.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", F.col("target").cast("double").alias("v"), usable.alias("usable")))).alias("h"))
    known = F.filter(F.transform("h", lambda x, i: F.struct(i.alias("i"), x["v"].alias("v"), x["usable"].alias("usable"))), lambda x: x["usable"])
    return rows.select(key, F.col("h")[0]["date"].alias("first"), F.transform("h", lambda x: x["v"]).alias("values"), F.transform(known, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"))).alias("known"))


def place(date: Column, frequency: Frequency) -> Column:
    """The place of the last period that begins on or before a date."""
    return F.floor(F.datediff(date, F.col("first")) / frequency.days).cast("int")


def when(at: Column, frequency: Frequency) -> Column:
    """The date of a place."""
    return F.date_add(F.col("first"), (at * frequency.days).cast("int"))


def rolling(histories: DataFrame, start: str, horizon: int, step: int, frequency: Frequency = DAILY) -> DataFrame:
    """Adds folds: array of (fold, at), every `step` periods from `start` on, while a whole horizon is known."""
    low, high = F.greatest(place(F.lit(start).cast("date"), frequency), F.lit(0)), F.size("values") - 1 - horizon
    places = F.when(low <= high, F.sequence(low, high, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return histories.withColumn("folds", F.transform(places, lambda at, k: F.struct(k.alias("fold"), at.alias("at"))))


def run_dates(histories: DataFrame, start: str, end: str, frequency: Frequency = DAILY) -> DataFrame:
    """Adds folds for each run date of a range: what was known then, from the series' first period on.

    `fold` counts days from `start`; a run after the last period starts from that.
    """
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    at = lambda d: F.least(place(d, frequency), F.size("values") - 1)
    runs = F.transform(days, lambda d: F.struct(F.datediff(d, F.lit(start).cast("date")).alias("fold"), at(d).alias("at")))
    return histories.withColumn("folds", F.filter(runs, lambda r: r["at"] >= 0))


def fold_table(histories: DataFrame, frequency: Frequency = DAILY, key: str = "series") -> DataFrame:
    """(series, fold, at, origin) of histories with folds."""
    return histories.select(key, "first", F.explode("folds").alias("f")).select(key, "f.fold", "f.at", when(F.col("f.at"), frequency).alias("origin"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last(values: Column, size: int) -> Column:
    """The last `size` elements, or all."""
    return F.slice(values, F.greatest(F.size(values) - size + 1, F.lit(1)), size)


def mean(values: Column) -> Column:
    """Mean of an array of numbers; null of none."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def median(values: Column) -> Column:
    """Median of an array of numbers; null of none."""
    low = lambda s: F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))
    return let(F.array_sort(values), lambda s: (low(s) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def tail(at: Column, size: int, known: str = "known") -> Column:
    """The last `size` usable (i, v) up to a place."""
    return let(F.filter(known, lambda x: x["i"] <= at), lambda upto: last(upto, size))


def _naive(at: Column, horizon: int, frequency: Frequency) -> Column:
    season = frequency.season
    back = lambda h: at + h - season * F.ceil(h / season).cast("int")
    fallback = F.coalesce(mean(F.transform(tail(at, season), lambda x: x["v"])), F.lit(0.0))
    wanted = F.transform(F.sequence(F.lit(1), F.lit(horizon)), back)
    reach = F.filter("known", lambda x: (x["i"] <= at) & (x["i"] > at - season))
    found = let(F.map_from_entries(reach), lambda m: let(fallback, lambda f: F.transform(wanted, lambda i: F.coalesce(F.try_element_at(m, i), f))))
    return F.transform(found, lambda v: F.greatest(v, F.lit(0.0)))


def _steps(start: Column, kind: str, horizon: int, value: Callable[[Column, Column], Column], entry: Callable[[Column, Column], Column], keep: int) -> Column:
    """Values of `horizon` steps, each made from a tail that earlier ones join."""
    state = f"struct<tail:array<{kind}>,out:array<double>>"

    def step(s: Column, h: Column) -> Column:
        return let(value(s["tail"], h), lambda v: F.struct(last(F.concat(s["tail"], F.array(entry(v, h))), keep).alias("tail"), F.concat(s["out"], F.array(v)).alias("out")).cast(state))

    begin = F.struct(start.alias("tail"), F.array().cast("array<double>").alias("out")).cast(state)
    made = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), begin, step, lambda s: s["out"])
    return F.transform(made, lambda v: F.greatest(v, F.lit(0.0)))


def _moving(at: Column, horizon: int, frequency: Frequency) -> Column:
    values = F.transform(tail(at, frequency.window), lambda x: x["v"])
    return _steps(values, "double", horizon, lambda t, h: F.coalesce(mean(t), F.lit(0.0)), lambda v, h: v, frequency.window)


def _weekday_median(at: Column, horizon: int, frequency: Frequency) -> Column:
    if frequency.days != 1:
        return _moving(at, horizon, frequency)
    day = lambda i: F.pmod(F.weekday("first") + i, F.lit(7)).cast("int")
    values = F.transform(tail(at, MEDIAN_OF), lambda x: F.struct(day(x["i"]).alias("w"), x["v"].alias("v")))

    def value(t: Column, h: Column) -> Column:
        same = F.transform(F.filter(t, lambda x: x["w"] == day(at + h)), lambda x: x["v"])
        return F.coalesce(median(same), median(F.transform(t, lambda x: x["v"])), F.lit(0.0))

    return _steps(values, "struct<w:int,v:double>", horizon, value, lambda v, h: F.struct(day(at + h).alias("w"), v.alias("v")), MEDIAN_OF)


_MADE = dict(zip(BASELINES, (_naive, _moving, _weekday_median), strict=True))


def baselines(histories: DataFrame, horizon: int, models: Sequence[str] = BASELINES, frequency: Frequency = DAILY, key: str = "series") -> DataFrame:
    """(series, fold, origin, model, step, date, y_true, y_pred) of every fold, by the models named.

    - seasonal_naive: the value a whole number of seasons back, on or before the origin; where that is
      a hole or before the first period, the mean of the last season of usable values;
    - moving_average: the mean of the last usable values, earlier forecasts included;
    - median_weekday: the median of the weekday among the last MEDIAN_OF; of weeks, the moving average.
    Without any usable value 0; never below 0. y_true is null beyond what is known.
    """
    def fold(f: Column) -> Column:
        at = f["at"]
        made = [F.struct(f["fold"].alias("fold"), at.alias("at"), F.lit(m).alias("model"), _MADE[m](at, horizon, frequency).alias("p"), F.slice("values", at + 2, horizon).alias("t")) for m in models]
        return F.array(*made)

    out = histories.select(key, "first", F.explode(F.flatten(F.transform("folds", fold))).alias("r"))
    return points(out.select(key, "first", "r.*"), frequency, key)


def points(rows: DataFrame, frequency: Frequency, key: str = "series") -> DataFrame:
    """One row for each step of (series, first, fold, at, model, p, t)."""
    out = rows.select(key, "first", "fold", "at", "model", "t", F.posexplode("p").alias("step", "y_pred"))
    step = F.col("step") + 1
    return out.select(key, "fold", when(F.col("at"), frequency).alias("origin"), "model", step.alias("step"), when(F.col("at") + step, frequency).alias("date"), F.get("t", F.col("step")).alias("y_true"), "y_pred")

"""Forecasts of daily and weekly series: rolling-origin backtests, their metrics, and the next forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from depotlane.lineage import cut
from depotlane.operators import histories, learned
from depotlane.operators.histories import BASELINES, DAILY, Frequency
from depotlane.operators.policy import POLICY, Policy

FITTED = ("ridge", "boosting")
MODELS = (*BASELINES, *FITTED)
#: Features that ablations leave out, one at a time, and for how many of the last folds.
ABLATED, RECENT = ("week_of_month", "easter_week", "ramp_up"), 12


def features(filled: DataFrame, calendar: DataFrame, frequency: Frequency = DAILY, exclude_years: Sequence[int] = (), policy: Policy = POLICY, key: str = "series") -> tuple[DataFrame, list[str], list[str]]:
    """(training rows, names of all features, names of those from the calendar): numeric columns that the policy allows."""
    own = policy.select(calendar)
    rows = learned.training(filled, calendar.select("date", *own), frequency, exclude_years, key)
    names = [*own, *learned.lag_names(frequency)]
    policy.check(names)
    return rows, names, own


def variants(model: str, ablate: Sequence[str] = ()) -> dict[str, tuple[str, ...]]:
    """The model with all features, and one without each feature named."""
    return {model: ()} | {f"{model}_no_{n}": (n,) for n in ablate}


def predictions(
    filled: DataFrame, folded: DataFrame, calendar: DataFrame, models: Sequence[str], horizon: int, step: int, frequency: Frequency = DAILY, exclude_years: Sequence[int] = (),
    ablate: Sequence[str] = (), recent: int = RECENT, policy: Policy = POLICY, key: str = "series",
) -> DataFrame:
    """Forecasts of every fold and model: (series, fold, origin, model, step, date, y_true, y_pred).

    folded: histories with folds, `step` periods apart. calendar: date and features, one row for each period that is
    learnt from or forecast. Ablations are made for the last `recent` folds of each series.
    """
    out, fitted = None, [m for m in models if m in FITTED]
    if chosen := [m for m in models if m in BASELINES]:
        out = histories.baselines(folded, horizon, chosen, frequency, key)
    if fitted:
        rows, names, own = features(filled, calendar, frequency, exclude_years, policy, key)
        rows, state = cut(rows), learned.states(folded, horizon, frequency, key)
        for model in fitted:
            wanted = variants(model, ablate)
            if model == "ridge":
                folds = cut(histories.fold_table(folded, frequency, key))
                slopes = learned.ridge(learned.grams(rows, folds, names, step, frequency, key), names, wanted, key)
                late = folds.groupBy(key).agg((F.max("fold") - recent).alias("late"))
                slopes = slopes.join(late, key).where((F.col("model") == model) | (F.col("fold") > F.col("late"))).drop("late")
                made = learned.by_ridge(state, slopes, names, calendar, own, horizon, frequency, key)
            else:
                made = learned.by_boosting(state, rows, names, wanted, calendar, own, horizon, frequency, {m: recent for m in wanted if m != model}, key)
            out = made if out is None else out.unionByName(made)
    return out


def backtest(
    filled: DataFrame, calendar: DataFrame, start: str, horizon: int, step: int, models: Sequence[str] = MODELS, frequency: Frequency = DAILY, exclude_years: Sequence[int] = (),
    ablate: Sequence[str] = (), recent: int = RECENT, policy: Policy = POLICY, key: str = "series",
) -> DataFrame:
    """Out-of-fold forecasts of every series, model and origin, from `start` on every `step` periods.

    Rows of excluded years don't train and are holes for what looks back, but are still forecast.
    """
    folded = cut(histories.rolling(histories.dense(filled, exclude_years, key), start, horizon, step, frequency))
    return predictions(filled, folded, calendar, models, horizon, step, frequency, exclude_years, ablate, recent, policy, key)


def out_of_fold(rows: DataFrame, ranking_until: int = 2000, key: str = "series") -> DataFrame:
    """Adds abs_error, peak (at least the 90 % quantile of its fold, none if all are 0) and the view.

    Dates up to the year `ranking_until` rank models, later ones test them under stress.
    """
    own = Window.partitionBy(key, "fold", "model")
    out = rows.withColumns({"limit": F.percentile("y_true", F.lit(0.9)).over(own), "size": F.sum(F.abs("y_true")).over(own), "abs_error": F.abs(F.col("y_pred") - F.col("y_true"))})
    return out.withColumns({"peak": (F.col("size") != 0) & (F.col("y_true") >= F.col("limit")), "view": F.when(F.year("date") <= ranking_until, "ranking").otherwise("stress")}).drop("limit", "size")


def metrics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """MAE, RMSE, WAPE (null without signal), bias and the peaks' MAE and WAPE of each group."""
    error, size = F.col("y_pred") - F.col("y_true"), F.abs("y_true")
    peak = lambda c: F.when(F.col("peak"), c)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("abs_error").alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.try_divide(F.sum("abs_error"), F.sum(size)).alias("wape"), F.avg(error).alias("bias"),
        F.avg(peak(F.col("abs_error"))).alias("mae_peak"), F.try_divide(F.sum(peak(F.col("abs_error"))), F.sum(peak(size))).alias("wape_peak"),
    )


def summarize(rows: DataFrame, key: str = "series") -> DataFrame:
    """Mean, median and spread over folds, the 90 % quantile of errors, the peaks' MAE and WAPE, and the rank of each model in its series."""
    per_fold = metrics(rows, [key, "fold", "model"])
    out = per_fold.groupBy(key, "model").agg(
        F.avg("mae").alias("mean_mae"), F.percentile("mae", F.lit(0.5)).alias("median_mae"), F.stddev_samp("mae").alias("std_mae"), F.avg("wape").alias("mean_wape"), F.avg("bias").alias("mean_bias")
    )
    peak = lambda c: F.when(F.col("peak"), c)
    whole = rows.groupBy(key, "model").agg(
        F.percentile("abs_error", F.lit(0.9)).alias("p90_abs_error"), F.avg(peak(F.col("abs_error"))).alias("mae_peak"), F.try_divide(F.sum(peak(F.col("abs_error"))), F.sum(peak(F.abs("y_true")))).alias("wape_peak")
    )
    out = out.join(whole, [key, "model"])
    order = [F.col(c).asc_nulls_last() for c in ("mean_wape", "mean_mae", "p90_abs_error", "model")]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def best_model(summary: DataFrame, series: DataFrame, default: str = "seasonal_naive", key: str = "series") -> DataFrame:
    """The model of rank 1 of each series, or the default."""
    return series.select(key).distinct().join(summary.where("rank = 1").select(key, "model"), key, "left").select(key, F.coalesce("model", F.lit(default)).alias("model"))


def forecast(
    filled: DataFrame, calendar: DataFrame, chosen: DataFrame, run_date: str, horizon: int, frequency: Frequency = DAILY, exclude_years: Sequence[int] = (), policy: Policy = POLICY, key: str = "series",
) -> DataFrame:
    """The next `horizon` periods after the last actual on or before the run date, by each series' chosen model.

    chosen: series, model; a model without a feature is named as in `variants`.
    """
    dense = histories.dense(filled, exclude_years, key).join(chosen, key)
    folded = cut(histories.run_dates(dense, run_date, run_date, frequency))
    out = None
    for model in sorted(r.model for r in folded.select("model").distinct().collect()):  # names of models: a handful
        base, _, gone = model.partition("_no_")
        if base not in MODELS:
            raise ValueError(f"no such model: {model}")
        own = folded.where(F.col("model") == model).drop("model")
        made = predictions(filled.join(own.select(key), key, "left_semi"), own, calendar, [base], horizon, 1, frequency, exclude_years, [gone] if gone else [], 1, policy, key)
        made = made.where(F.col("model") == model)
        out = made if out is None else out.unionByName(made)
    if out is None:
        out = histories.baselines(folded.drop("model"), horizon, BASELINES[:1], frequency, key)  # no series, no rows
    return out.select(key, "model", "date", "step", F.col("y_pred").alias("forecast"))

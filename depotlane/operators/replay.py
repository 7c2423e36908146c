"""Replay: the forecasts that each run date would have made, under settings before and after a change.

Run dates are folds of the histories and origins of the open requests, so one plan makes all of them: what a run
could know is what lies on or before its date.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from depotlane.functions.text import monday
from depotlane.operators import histories, nowcast


@dataclass(frozen=True)
class Settings:
    """Weights (statistical, backlog) by type and bucket, those of other short horizons, and post-processing by KPI."""

    weights: Mapping[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    default: tuple[float, float] = nowcast.DEFAULT
    policies: Mapping[str, Mapping[str, float]] = field(default_factory=dict)


def base(folded: DataFrame, types: Mapping[str, str], horizon: int, model: str = "seasonal_naive") -> DataFrame:
    """(origin, date, kpi, service_type, forecast, actual_value) of every run date of histories keyed by kpi.

    types: the service type of each KPI of services; other KPIs have none and are never blended.
    """
    made = histories.baselines(folded, horizon, [model], key="kpi")
    kinds = F.create_map(*[F.lit(x) for pair in types.items() for x in pair]) if types else F.create_map().cast("map<string,string>")
    return made.select("origin", "date", "kpi", F.try_element_at(kinds, F.col("kpi")).alias("service_type"), F.col("y_pred").alias("forecast"), F.col("y_true").alias("actual_value"))


def replay(rows: DataFrame, signal: DataFrame, settings: Mapping[str, Settings]) -> DataFrame:
    """One row for each variant, run date, target date and KPI: base, signal, weights, blend, final value, actual and errors.

    rows: of `base`; signal: of `nowcast.signals` at the run dates; only dates within a horizon bucket stay.
    """
    spark, out = rows.sparkSession, None
    joined = rows.join(signal, ["origin", "date", "service_type"], "left")
    for name, s in settings.items():
        own = nowcast.weigh(joined, nowcast.blend_weights(spark, s.weights), s.default).where("bucket is not null")
        service = F.col("service_type").isNotNull()
        own = own.select(
            F.lit(name).alias("variant"), F.col("origin").alias("run_date"), F.col("date").alias("target_date"), "horizon", "bucket", "kpi", F.col("forecast").alias("base"), "signal",
            *[F.when(service, F.col(c)).alias(c) for c in ("statistical", "backlog")], F.when(service, F.col("blended")).otherwise(F.col("forecast")).alias("blended"), "actual_value",
        ).withColumn("forecast_value", F.col("blended"))
        own = nowcast.postprocess(own, s.policies, value="forecast_value")
        out = own if out is None else out.unionByName(own)
    e = F.col("forecast_value") - F.col("actual_value")
    return out.withColumns({"error": e, "abs_error": F.abs(e)})


def weekly(rows: DataFrame, actuals: DataFrame) -> DataFrame:
    """Weeks of each variant, run date and KPI: sums of the days forecast, and the actuals of whole weeks.

    actuals: date, kpi, actual_value of every day.
    """
    week = monday(F.col("target_date")).alias("week")
    known = actuals.groupBy(monday(F.col("date")).alias("week"), "kpi").agg(F.sum("actual_value").alias("actual_value"))
    out = rows.groupBy("variant", "run_date", "kpi", week).agg(F.sum("forecast_value").alias("forecast_value"))
    out = out.join(known, ["week", "kpi"], "left")
    return out.withColumn("error", F.col("forecast_value") - F.col("actual_value"))


#: Least changes of MAE and WAPE that count as a help or a harm.
MAE_STEP, WAPE_STEP = 0.05, 0.02


def report(rows: DataFrame, by: Sequence[str], before: str = "before", after: str = "after") -> DataFrame:
    """Metrics of both variants by group, their differences, and whether the change helped."""
    known = rows.where("actual_value is not null and forecast_value is not null")
    own = nowcast.horizon_metrics(known, ["variant", *by], "forecast_value", "actual_value")
    names = ["n", "mae", "wape", "bias", "median_error", "p90_error"]
    side = lambda variant, tail: own.where(F.col("variant") == variant).select(*by, *[F.col(c).alias(f"{c}_{tail}") for c in names])
    out = side(before, "before").join(side(after, "after"), list(by), "full")
    out = out.withColumns({f"delta_{c}": F.col(f"{c}_after") - F.col(f"{c}_before") for c in ("mae", "wape", "bias")})
    helped = (F.col("delta_mae") <= -MAE_STEP) | (F.col("delta_wape") <= -WAPE_STEP)
    harmed = (F.col("delta_mae") >= MAE_STEP) | (F.col("delta_wape") >= WAPE_STEP)
    return out.withColumn("impact", F.when(helped, "helpful").when(harmed, "harmful").otherwise("neutral"))

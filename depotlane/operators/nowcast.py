"""Nowcasting from open requests: visibility curves, scalers, blending, post-processing, picks from services."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from depotlane.functions.text import daily_bucket

#: Weights (statistical, backlog) by type and bucket within SHORT days; outside, the forecast stands.
WEIGHTS = {
    ("SGE", "D+1"): (0.0, 1.0), ("SGE", "D+2_D+3"): (0.0, 1.0), ("SGE", "D+4_D+7"): (0.65, 0.35), ("SGP", "D+1"): (0.0, 1.0), ("SGP", "D+2_D+3"): (0.45, 0.55),
    ("SGP", "D+4_D+7"): (0.65, 0.35), ("EGE", "D+1"): (1.0, 0.0), ("EGE", "D+2_D+3"): (1.0, 0.0), ("EGE", "D+4_D+7"): (1.0, 0.0),
}
SHORT, DEFAULT = 7, (0.35, 0.65)


def maturity_curves(requests: DataFrame, most: int = 28) -> DataFrame:
    """Median share of a day's requests that are visible h days before, by type and h, within [0.05, 1].

    Requests become a histogram of lead days by target day and type; the horizons multiply
    its few rows and not the requests.
    """
    lead = requests.where("date is not null and created_date is not null").groupBy("date", "service_type", F.datediff("date", "created_date").alias("lead")).agg(F.count("*").alias("n"))
    grid = lead.withColumn("horizon", F.explode(F.sequence(F.lit(0), F.lit(most))))
    ratio = grid.groupBy("date", "service_type", "horizon").agg((F.sum(F.when(F.col("lead") >= F.col("horizon"), F.col("n")).otherwise(0)) / F.sum("n")).alias("ratio"))
    out = ratio.groupBy("service_type", "horizon").agg(F.percentile("ratio", F.lit(0.5)).alias("visible"))
    return out.withColumn("visible", F.least(F.greatest(F.col("visible"), F.lit(0.05)), F.lit(1.0)))


def scalers(actuals: DataFrame, requests: DataFrame, truth: str | None = None) -> DataFrame:
    """Median ratio of actuals (date, service_type, actual) to requests due that day, by type; 1 without any.

    With `truth`, a column of labels, only rows that are final count, unless none is.
    """
    if truth:
        any_final = F.max((F.col(truth) == "final").cast("int")).over(Window.partitionBy(F.lit(0)))  # actuals have a row for each day and type
        actuals = actuals.withColumn("_final", any_final).where((F.col(truth) == "final") | (F.col("_final") == 0)).drop("_final")
    due = requests.groupBy("date", "service_type").agg(F.count("*").alias("due"))
    both = actuals.join(due, ["date", "service_type"], "left").withColumn("ratio", F.try_divide(F.col("actual"), F.col("due")))
    return both.groupBy("service_type").agg(F.coalesce(F.percentile("ratio", F.lit(0.5)), F.lit(1.0)).alias("scaler"))


def blend_weights(spark, weights: Mapping[tuple[str, str], tuple[float, float]] = WEIGHTS) -> DataFrame:
    """The weights as a table (a few rows)."""
    rows = [(k, b, s / (s + c), c / (s + c)) for (k, b), (s, c) in weights.items()]
    return spark.createDataFrame(rows, "service_type string, bucket string, statistical double, backlog double")


def signals(opened: DataFrame, scaler: DataFrame, curves: DataFrame) -> DataFrame:
    """(origin, date, service_type, signal): what open requests (origin, target_date, service_type) lead to expect."""
    out = opened.withColumn("horizon", F.greatest(F.datediff("target_date", "origin"), F.lit(0))).join(F.broadcast(scaler), "service_type", "left").join(F.broadcast(curves), ["service_type", "horizon"], "left")
    return out.select("origin", F.col("target_date").alias("date"), "service_type", (F.col("open_requests") / F.coalesce("visible", F.lit(1.0)) * F.coalesce("scaler", F.lit(1.0))).alias("signal"))


def weigh(rows: DataFrame, weights: DataFrame, default: tuple[float, float] = DEFAULT) -> DataFrame:
    """Adds horizon, bucket, weights and the blend of forecast and signal (the forecast itself where there is none)."""
    out = rows.withColumn("horizon", F.datediff("date", "origin")).withColumn("bucket", daily_bucket(F.col("horizon")))
    out = out.join(F.broadcast(weights), ["service_type", "bucket"], "left")  # some rows of settings
    short = F.col("horizon").between(0, SHORT)
    s = F.when(short, F.coalesce("statistical", F.lit(default[0]))).otherwise(1.0)
    c = F.when(short, F.coalesce("backlog", F.lit(default[1]))).otherwise(0.0)
    return out.withColumns({"statistical": s, "backlog": c, "blended": F.col("forecast") * s + F.coalesce("signal", "forecast") * c})


def blend(forecast: DataFrame, opened: DataFrame, scaler: DataFrame, curves: DataFrame, weights: DataFrame) -> DataFrame:
    """Forecasts (origin, date, service_type, forecast) blended with what open requests (origin, target_date, service_type) signal."""
    return weigh(forecast.join(signals(opened, scaler, curves), ["origin", "date", "service_type"], "left"), weights)


def postprocess(df: DataFrame, policies: Mapping[str, Mapping[str, float]], kpi: str = "kpi", value: str = "forecast") -> DataFrame:
    """Multiplier, bias, limits and rounding (half to even) of each KPI's policy; never below 0."""
    out = F.coalesce(F.col(value), F.lit(0.0))
    for name, policy in policies.items():
        x = F.greatest(F.col(value) * policy.get("multiplier", 1.0) + policy.get("add_bias", 0.0), F.lit(policy.get("clip_min", 0.0)))
        if "clip_max" in policy:
            x = F.least(x, F.lit(policy["clip_max"]))
        out = F.when(F.col(kpi) == name, F.rint(x) if policy.get("round") else x).otherwise(out)
    return df.withColumn(value, F.greatest(out, F.lit(0.0)))


def fit_transformer(matched: DataFrame, services: DataFrame) -> dict[str, DataFrame]:
    """How services turn into picks: intensity and share by offset of each type and urgency, mix of urgencies, overall curve.

    matched: service_type, urgency, code, offset, quantity; services: service_type, urgency.
    """
    own = ["service_type", "urgency"]
    per = matched.groupBy(*own).agg(F.countDistinct("code").alias("services"), F.count("*").alias("lines"), F.sum("quantity").alias("units"))
    intensity = per.select(*own, (F.col("lines") / F.col("services")).alias("lines_per_service"), (F.col("units") / F.col("services")).alias("units_per_service"))
    share = lambda df, by, within, name: df.groupBy(*by).agg(F.count("*").alias("n")).withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*within))).drop("n")
    return {"intensity": intensity, "offsets": share(matched, [*own, "offset"], own, "share"), "urgency": share(services, own, ["service_type"], "mix"), "overall": share(matched, ["offset"], [], "share")}


def known_at(rows: DataFrame, origins: DataFrame, by: Sequence[str], sums: Sequence[str], day: str = "day") -> DataFrame:
    """(origin, by, sums): sums over the rows of each group up to each origin date, for groups that have any by then.

    Rows become sums by the first origin that sees them, and origins add up those of earlier ones: no row meets
    more than one origin. origins: one column of dates (folds, so few).
    """
    one = origins.agg(F.array_sort(F.collect_set("origin")).alias("origins"))
    days = rows.groupBy(*by, day).agg(*[F.sum(c).alias(c) for c in sums]).crossJoin(F.broadcast(one))  # one row of dates
    first = days.withColumn("origin", F.get(F.filter("origins", lambda o: o >= F.col(day)), F.lit(0))).where("origin is not null")
    first = first.groupBy("origin", *by).agg(*[F.sum(c).alias(c) for c in sums])
    grid = first.select(*by).distinct().crossJoin(F.broadcast(one)).withColumn("origin", F.explode("origins")).drop("origins")
    so_far = Window.partitionBy(*by).orderBy("origin").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(first, ["origin", *by], "left")
    return out.withColumns({c: F.sum(c).over(so_far) for c in sums}).where(F.col(sums[0]).isNotNull())


def fit_transformer_at(matched: DataFrame, services: DataFrame, origins: DataFrame) -> dict[str, DataFrame]:
    """The tables of `fit_transformer` as known at each origin, with an origin column.

    matched: service_type, urgency, code, offset, quantity, pick_date, date; a row is known once it was picked and
    served. services: service_type, urgency, date.
    """
    own = ["service_type", "urgency"]
    rows = matched.withColumns({"day": F.greatest("pick_date", "date"), "lines": F.lit(1), "units": F.col("quantity")})
    offsets = known_at(rows, origins, [*own, "offset"], ["lines", "units"])
    codes = known_at(rows.groupBy(*own, "code").agg(F.min("day").alias("day")).withColumn("codes", F.lit(1)), origins, own, ["codes"])
    whole = offsets.groupBy("origin", *own).agg(F.sum("lines").alias("lines"), F.sum("units").alias("units"))
    mixes = known_at(services.select(*own, F.col("date").alias("day"), F.lit(1).alias("n")), origins, own, ["n"])
    share = lambda df, column, within, name: df.withColumn(name, F.col(column) / F.sum(column).over(Window.partitionBy("origin", *within)))
    overall = offsets.groupBy("origin", "offset").agg(F.sum("lines").alias("lines"))
    return {
        "intensity": whole.join(codes, ["origin", *own]).select("origin", *own, (F.col("lines") / F.col("codes")).alias("lines_per_service"), (F.col("units") / F.col("codes")).alias("units_per_service")),
        "offsets": share(offsets, "lines", own, "share").select("origin", *own, "offset", "share"),
        "urgency": share(mixes, "n", ["service_type"], "mix").select("origin", *own, "mix"),
        "overall": share(overall, "lines", [], "share").select("origin", "offset", "share"),
    }


def apply_transformer(services: DataFrame, model: Mapping[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Picks that forecast services (date, service_type, forecast) lead to, by day and type.

    Types without a mix count as UNKNOWN; types and urgencies without an intensity lead to
    nothing; those without offsets take the overall curve. Model tables have a few rows each
    (for each value of `by`, columns that services and model share, such as an origin).
    """
    own = [*by, "service_type", "urgency"]
    mixed = services.join(F.broadcast(model["urgency"]), [*by, "service_type"], "left").fillna({"urgency": "UNKNOWN", "mix": 1.0})
    known = mixed.join(F.broadcast(model["intensity"]), own).join(F.broadcast(model["offsets"]), own, "left")
    lacking, overall = known.where("offset is null").drop("offset", "share"), F.broadcast(model["overall"])
    lacking = lacking.join(overall, list(by)) if by else lacking.crossJoin(overall)
    spread = known.where("offset is not null").unionByName(lacking).withColumn("pick_date", F.expr("date_sub(date, offset)"))
    part = F.col("forecast") * F.col("mix") * F.col("share")
    return spread.groupBy(*by, "pick_date", "service_type").agg(F.sum(part * F.col("lines_per_service")).alias("lines"), F.sum(part * F.col("units_per_service")).alias("units"))


def direct_and_transformed(direct: DataFrame, picks: DataFrame, kpis: Sequence[str] = ("lines", "units")) -> DataFrame:
    """(origin, kpi, date, source, y_true, y_pred): direct forecasts beside the picks that forecast services lead to.

    direct: origin, kpi, date, y_true, y_pred of every day to compare; picks: of `apply_transformer` by origin, summed
    over types; 0 on days that no service leads to.
    """
    long = picks.groupBy("origin", F.col("pick_date").alias("date")).agg(*[F.sum(k).alias(k) for k in kpis]).unpivot(["origin", "date"], list(kpis), "kpi", "made")
    other = direct.drop("y_pred").join(long, ["origin", "kpi", "date"], "left").withColumn("y_pred", F.coalesce("made", F.lit(0.0))).drop("made")
    columns = ["origin", "kpi", "date", "y_true", "y_pred"]
    return direct.select(*columns, F.lit("direct").alias("source")).unionByName(other.select(*columns, F.lit("transformer").alias("source")))


def horizon_metrics(rows: DataFrame, by: Sequence[str], forecast: str = "forecast", actual: str = "actual") -> DataFrame:
    """Number, MAE, WAPE, bias, median and 90 % quantile of errors."""
    e = F.col(forecast) - F.col(actual)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(actual))).alias("wape"), F.avg(e).alias("bias"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_error"), F.percentile(F.abs(e), F.lit(0.9)).alias("p90_error")
    )


def impact(before: DataFrame, after: DataFrame, by: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """WAPE before and after a change, and whether it helped."""
    both = before.select(*by, F.col("wape").alias("before")).join(after.select(*by, F.col("wape").alias("after")), list(by), "full")
    d = F.col("after") - F.col("before")
    return both.withColumns({"delta": d, "impact": F.when(d < -tolerance, "helpful").when(d > tolerance, "harmful").otherwise("neutral")})


def usage(metrics: DataFrame, kpi: str = "kpi") -> DataFrame:
    """Recommended use of each KPI's forecast from its mean WAPE."""
    out = metrics.groupBy(kpi).agg(F.avg("wape").alias("wape"))
    return out.withColumn("use", F.when(F.col("wape") <= 0.35, "operational").when(F.col("wape") <= 0.70, "indicative").otherwise("exploratory"))

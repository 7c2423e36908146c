"""Queries on forecasts, nowcasts, tracking, consumption tables and item graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlane.functions import text as t
from depotlane.lineage import cut, stored
from depotlane.operators import basket, enrich, facts, forecast, graph, histories, learned, nowcast, quality, replay, tracking
from depotlane.operators.calendar import weekly_calendar
from depotlane.plans import basket as baskets
from depotlane.plans.service import ORACLES as SERVICE, _ACT, _CAL, _FR, _LV, _days, _level, _picking, _round, _series, fact_service_actuals
from depotlane.sources import files, staging
from depotlane.sources.staging import CTES

RUN, KPIS = "2001-03-14", ["lines", "units"]
#: First origins, horizons (periods) and steps of backtests, and the year that training leaves out.
FOLD_START, HORIZON, STEP, WEEKS, LEFT_OUT, RESTART = "1997-12-31", 28, 7, 8, 1999, "2000-01-01"


def _daily_series(spark, sf_dir):
    """Orders per day and priority, 0 where there are none."""
    return histories.fill(_series(spark, sf_dir))


def _folded(spark, sf_dir):
    return histories.rolling(histories.dense(_daily_series(spark, sf_dir), [LEFT_OUT]), FOLD_START, HORIZON, STEP)


def _calendar(spark):
    """Calendar features of every day that is learnt from or forecast."""
    return _days(spark).withColumn("ramp_up", t.ramp_up(F.col("date"), RESTART))


def forecast_folds(spark, sf_dir):
    return histories.fold_table(_folded(spark, sf_dir)).select("series", F.col("fold").cast("long").alias("fold"), "origin")


def _baselines(spark, sf_dir, models=forecast.BASELINES):
    return histories.baselines(_folded(spark, sf_dir), HORIZON, models)


def forecast_seasonal_naive(spark, sf_dir):
    return _round(_baselines(spark, sf_dir, ("seasonal_naive",)).select("series", "origin", "date", "step", F.col("y_pred").alias("forecast")), "forecast")


def forecast_baselines(spark, sf_dir):
    return _round(_baselines(spark, sf_dir), "y_pred")


def forecast_weekly(spark, sf_dir):
    weeks = histories.WEEKLY
    filled = histories.fill(histories.weekly(_series(spark, sf_dir)), weeks)
    return _round(histories.baselines(histories.rolling(histories.dense(filled, [LEFT_OUT]), FOLD_START, WEEKS, 1, weeks), WEEKS, frequency=weeks), "y_pred")


def forecast_weekly_fitted(spark, sf_dir):
    weeks = histories.WEEKLY
    filled = histories.fill(histories.weekly(_series(spark, sf_dir)), weeks)
    calendar = weekly_calendar(_days(spark)).withColumnRenamed("week", "date")
    return _round(forecast.backtest(filled, calendar, FOLD_START, WEEKS, 1, ("ridge",), weeks, [LEFT_OUT]), "y_pred", digits=3)


def _oof(spark, sf_dir, models=forecast.MODELS):
    made = forecast.backtest(_daily_series(spark, sf_dir), _calendar(spark), FOLD_START, HORIZON, STEP, models, exclude_years=[LEFT_OUT])
    return forecast.out_of_fold(made)


def forecast_backtest(spark, sf_dir):
    return _round(_oof(spark, sf_dir), "y_pred", "abs_error")


def forecast_backtest_naive(spark, sf_dir):
    return _round(_oof(spark, sf_dir, ("seasonal_naive",)).select("series", "fold", "date", "y_true", "y_pred", "peak", "view"), "y_pred")


def forecast_metrics(spark, sf_dir):
    out = forecast.metrics(_oof(spark, sf_dir, ("seasonal_naive",)), ["series", "fold"])
    return _round(out, "mae", "rmse", "wape", "bias", "mae_peak", "wape_peak").withColumn("bias", F.col("bias") + 0.0)  # no -0.0


def forecast_rank_baselines(spark, sf_dir):
    out = forecast.summarize(cut(_oof(spark, sf_dir, forecast.BASELINES)))
    return _round(out, "mean_mae", "median_mae", "std_mae", "mean_wape", "mean_bias", "p90_abs_error", "mae_peak", "wape_peak")


#: Models that are ranked and then forecast: trees, fitted anew for every fold, are left to `forecast_backtest`.
RANKED = (*forecast.BASELINES, "ridge")


def forecast_ranking(spark, sf_dir):
    return forecast.summarize(cut(_oof(spark, sf_dir, RANKED)))


def forecast_next(spark, sf_dir):
    daily = _daily_series(spark, sf_dir)
    chosen = forecast.best_model(forecast_ranking(spark, sf_dir), daily)
    return forecast.forecast(daily, _calendar(spark), cut(chosen), RUN, HORIZON, exclude_years=[LEFT_OUT])


def forecast_next_baselines(spark, sf_dir):
    daily = _daily_series(spark, sf_dir)
    chosen = forecast.best_model(forecast.summarize(cut(_oof(spark, sf_dir, forecast.BASELINES))), daily)
    return _round(forecast.forecast(daily, _calendar(spark), cut(chosen), RUN, HORIZON, exclude_years=[LEFT_OUT]), "forecast")


def _last_folds(spark, sf_dir):
    """Histories with their last folds, those of ablations."""
    return cut(_folded(spark, sf_dir).withColumn("folds", histories.last(F.col("folds"), forecast.RECENT)))


def forecast_ablations(spark, sf_dir):
    out = forecast.predictions(_daily_series(spark, sf_dir), _last_folds(spark, sf_dir), _calendar(spark), forecast.FITTED, HORIZON, STEP, exclude_years=[LEFT_OUT], ablate=forecast.ABLATED)
    return _round(forecast.metrics(forecast.out_of_fold(out), ["series", "fold", "model"]), "mae", "rmse", "wape", "bias", "mae_peak", "wape_peak")


def forecast_ridge(spark, sf_dir):
    rows, names, _ = forecast.features(_daily_series(spark, sf_dir), _calendar(spark), exclude_years=[LEFT_OUT])
    folds = histories.fold_table(_last_folds(spark, sf_dir))
    slopes = learned.ridge(learned.grams(rows, folds, names, STEP, histories.DAILY), names, forecast.variants("ridge", forecast.ABLATED))
    out = slopes.select("series", "fold", "model", F.posexplode("slopes").alias("k", "slope"))
    return _round(out.select("series", "fold", "model", F.element_at(F.array(*map(F.lit, [*names, "level"])), F.col("k") + 1).alias("feature"), "slope"), "slope", digits=4)


def forecast_features(spark, sf_dir):
    """What the policy lets models learn from, by feature, over all usable rows."""
    rows, names, _ = forecast.features(_daily_series(spark, sf_dir), _calendar(spark), exclude_years=[LEFT_OUT])
    long = rows.where("usable").select(*[F.col(n).cast("double").alias(n) for n in names], "target").unpivot(["target"], names, "feature", "value")
    out = long.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg(F.col("value") * F.col("target")).alias("product"))
    return _round(out, "mean", "product", digits=5)


def nowcast_maturity(spark, sf_dir):
    return _round(nowcast.maturity_curves(_level(spark, sf_dir), HORIZON), "visible")


def _service_actuals(level):
    return level.where("lines > 2").groupBy("date", "service_type").agg(F.count("*").alias("actual"))


def nowcast_scalers(spark, sf_dir):
    level = stored(_level(spark, sf_dir))
    return _round(nowcast.scalers(_service_actuals(level), level), "scaler")


def nowcast_scalers_final(spark, sf_dir):
    """Scalers from the final part of the hybrid actuals."""
    actuals = fact_service_actuals(spark, sf_dir).select("date", F.upper("kpi").alias("service_type"), F.col("actual_value").alias("actual"), "actual_truth")
    return _round(nowcast.scalers(actuals, _level(spark, sf_dir), "actual_truth"), "scaler")


def nowcast_blend(spark, sf_dir):
    level = stored(_level(spark, sf_dir))
    origins = spark.sql("select explode(sequence(date'1995-01-02', date'2001-06-25', interval 7 day)) as origin")
    opened = enrich.open_at(level, origins, "created_date", "date", ["service_type"])
    plain = origins.withColumn("service_type", F.explode(F.array(*[F.lit(x) for x in ("SGE", "SGP", "EGE", "UNK")]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(14))))
    plain = plain.select("origin", F.date_add("origin", F.col("step")).alias("date"), "service_type", (F.col("step") + 0.5).cast("double").alias("forecast"))
    used = level.select("service_type").distinct()
    out = nowcast.blend(plain.join(used, "service_type", "left_semi"), opened, nowcast.scalers(_service_actuals(level), level), nowcast.maturity_curves(level, 14), nowcast.blend_weights(spark))
    return _round(out.select("origin", "date", "service_type", "forecast", "bucket", "statistical", "backlog", "blended"), "blended")


def nowcast_postprocess(spark, sf_dir):
    rows = facts.actuals_daily(_picking(spark, sf_dir), KPIS).select("date", "kpi", (F.col("actual_value") * 1.25 - 3).alias("forecast"))
    return nowcast.postprocess(rows, {"lines": {"round": True}, "units": {"add_bias": 500.0, "multiplier": 0.5, "clip_max": 900.0, "round": True}})


def _urgent(level):
    """Requests with their code and an urgency."""
    return level.select(F.regexp_extract("generic_code", "([0-9]+)$", 1).alias("code"), "service_type", "date", F.when(F.col("lines") > 4, "SI").otherwise("NO").alias("urgency"))


def _matched(spark, sf_dir, level):
    picks = staging.movements(spark, sf_dir).where("movement_type = 'PI' and external_order_id is not null").select(F.col("external_order_id").alias("code"), "operational_date", "quantity")
    return level.join(picks, "code").withColumn("offset", F.datediff("date", "operational_date")).where("offset between 0 and 60")


def nowcast_transformer(spark, sf_dir):
    level = stored(_urgent(_level(spark, sf_dir)))
    model = nowcast.fit_transformer(stored(_matched(spark, sf_dir, level)), level)
    out = nowcast.apply_transformer(level.groupBy("date", "service_type").agg(F.count("*").cast("double").alias("forecast")), model)
    return _round(out, "lines", "units")


def _direct(spark, sf_dir):
    """Picking forecast directly and by way of forecast services, as known at origins 28 days apart."""
    requests = stored(_level(spark, sf_dir))
    level = _urgent(requests)
    series = _service_actuals(requests).select(F.col("service_type").alias("series"), "date", F.col("actual").cast("double").alias("target"))
    picks = facts.actuals_daily(_picking(spark, sf_dir), KPIS).select(F.col("kpi").alias("series"), "date", F.col("actual_value").alias("target"))
    folded = histories.rolling(histories.dense(histories.fill(series.unionByName(picks)), [LEFT_OUT]), FOLD_START, HORIZON, HORIZON)
    made = cut(histories.baselines(folded, HORIZON, ["seasonal_naive"]))
    services = made.where(~F.col("series").isin(KPIS)).select("origin", "date", F.col("series").alias("service_type"), F.col("y_pred").alias("forecast"))
    direct = made.where(F.col("series").isin(KPIS)).select("origin", F.col("series").alias("kpi"), "date", "y_true", "y_pred")
    origins = services.select("origin").distinct()
    matched = _matched(spark, sf_dir, level).withColumnRenamed("operational_date", "pick_date").where(F.year("pick_date") != LEFT_OUT)
    model = nowcast.fit_transformer_at(stored(matched), level.where(F.year("date") != LEFT_OUT), origins)
    transformed = nowcast.apply_transformer(services, model, ["origin"])
    return nowcast.direct_and_transformed(direct.join(origins, "origin", "left_semi"), transformed)


def nowcast_direct(spark, sf_dir):
    return _round(_direct(spark, sf_dir), "y_pred")


def nowcast_direct_metrics(spark, sf_dir):
    rows = _direct(spark, sf_dir).select(F.col("kpi").alias("series"), F.col("origin").alias("fold"), F.col("source").alias("model"), "date", "y_true", "y_pred")
    out = forecast.metrics(forecast.out_of_fold(rows), ["series", "fold", "model"])
    return _round(out.select(F.col("series").alias("kpi"), F.col("fold").alias("origin"), F.col("model").alias("source"), "n", "mae", "rmse", "wape", "mae_peak", "wape_peak"), "mae", "rmse", "wape", "mae_peak", "wape_peak", digits=4)


#: Run dates that are replayed, KPIs of services with their types, and settings before and after a change.
REPLAY_FROM, REPLAY_TO, TYPES = "2000-07-01", "2001-06-30", {"sge": "SGE", "sgp": "SGP", "ege": "EGE"}
SETTINGS = {
    "before": replay.Settings(),
    "after": replay.Settings(nowcast.WEIGHTS, policies={"sge": {"round": True}, "ege": {"round": True}, "lines": {"round": True}, "units": {"add_bias": 500.0, "round": True}}),
}


def _kpi_actuals(spark, sf_dir, level):
    """Daily actuals of services and picking, one row for each KPI and day between its first and its last."""
    services = _service_actuals(level).where(F.col("service_type").isin(*TYPES.values())).select(F.lower("service_type").alias("kpi"), "date", F.col("actual").cast("double").alias("target"))
    picks = facts.actuals_daily(_picking(spark, sf_dir), KPIS).select("kpi", "date", F.col("actual_value").alias("target"))
    return histories.fill(services.unionByName(picks), key="kpi")


def _replayed(spark, level, actuals):
    runs = histories.run_dates(histories.dense(actuals, [LEFT_OUT], "kpi"), REPLAY_FROM, REPLAY_TO)
    origins = spark.sql(f"select explode(sequence(date'{REPLAY_FROM}', date'{REPLAY_TO}')) as origin")
    opened = enrich.open_at(level, origins, "created_date", "date", ["service_type"])
    signal = nowcast.signals(opened, nowcast.scalers(_service_actuals(level), level), nowcast.maturity_curves(level, HORIZON))
    return replay.replay(replay.base(runs, TYPES, HORIZON), signal, SETTINGS)


def forecast_replay(spark, sf_dir):
    level = stored(_level(spark, sf_dir))
    out = _replayed(spark, level, cut(_kpi_actuals(spark, sf_dir, level)))
    return _round(out, "base", "signal", "blended", "forecast_value", "error", "abs_error", digits=4)


def forecast_replay_report(spark, sf_dir):
    level = stored(_level(spark, sf_dir))
    out = replay.report(cut(_replayed(spark, level, cut(_kpi_actuals(spark, sf_dir, level)))), ["kpi", "bucket"])
    return _round(out, *[c for c, kind in out.dtypes if kind == "double"], digits=4)


def forecast_replay_weekly_report(spark, sf_dir):
    level = stored(_level(spark, sf_dir))
    actuals = cut(_kpi_actuals(spark, sf_dir, level))
    out = replay.report(cut(replay.weekly(_replayed(spark, level, actuals), actuals.withColumnRenamed("target", "actual_value"))), ["kpi"])
    return _round(out, *[c for c, kind in out.dtypes if kind == "double"], digits=4)


def forecast_replay_weekly(spark, sf_dir):
    level = stored(_level(spark, sf_dir))
    actuals = cut(_kpi_actuals(spark, sf_dir, level))
    out = replay.weekly(_replayed(spark, level, actuals), actuals.withColumnRenamed("target", "actual_value"))
    return _round(out, "forecast_value", "error", digits=4)


#: First of the runs in the history, a week apart up to RUN, and the number of the last one.
RUN_FROM, LAST_RUN = "2000-03-15", 52


def _daily(spark, sf_dir):
    """Daily actuals of picking, written once, as several parts of a query read these few rows."""
    return cut(facts.actuals_daily(_picking(spark, sf_dir), KPIS))


def _history(spark, sf_dir, daily=None):
    """Weekly runs of a year that forecast the picking KPIs by seasonal naive, each told twice, the later telling being right."""
    actuals = (_daily(spark, sf_dir) if daily is None else daily).select("date", "kpi", F.col("actual_value").alias("target"))
    runs = histories.run_dates(histories.dense(histories.fill(actuals, key="kpi"), key="kpi"), RUN_FROM, RUN).withColumn("folds", F.filter("folds", lambda f: f["fold"] % 7 == 0))
    made = histories.baselines(runs, HORIZON, ["seasonal_naive"], key="kpi").select("origin", F.col("date").alias("target_date"), "kpi", F.col("y_pred").alias("forecast_value"), F.lit("naive").alias("model"))
    run = F.datediff("origin", F.lit(RUN_FROM).cast("date")) / 7
    rows = tracking.stamp(cut(made), F.col("origin").cast("timestamp") + F.expr("interval 6 hours"), F.concat(F.lit("run"), run.cast("int").cast("string")), "2001-03-10").drop("origin")
    early = rows.withColumn("forecast_value", F.lit(-1.0)).withColumn("run_ts", F.col("run_ts") - F.expr("interval 1 hour"))
    old = F.col("run_date") < F.lit("2000-09-01").cast("date")
    return cut(tracking.append_history(rows.where(old).unionByName(early.where(old)), rows.where(~old).unionByName(early.where(~old))))  # read by several parts


def tracking_history(spark, sf_dir):
    return _history(spark, sf_dir).select("run_id", "target_date", "kpi", "forecast_value", "source", F.col("run_date"))


def tracking_split(spark, sf_dir):
    official, rest = files.split_history(_history(spark, sf_dir), ["notes"])
    columns = ["run_id", "target_date", "kpi", "source"]
    return official.select(*columns, F.lit("official").alias("part")).unionByName(rest.select(*columns, F.lit("rest").alias("part")))


def tracking_weekly(spark, sf_dir):
    return tracking.weekly_history(_history(spark, sf_dir)).select("run_id", "kpi", "week", "forecast_value", "days")


def tracking_errors(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    out = tracking.against_actuals(_history(spark, sf_dir, daily), daily)
    return _round(out.select("run_id", "target_date", "kpi", "error", "abs_error", "ape", "horizon"), "ape")


def tracking_horizons(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    out = tracking.against_actuals(_history(spark, sf_dir, daily), daily).withColumn("bucket", t.daily_bucket(F.col("horizon"))).where("bucket is not null")
    return _round(nowcast.horizon_metrics(out, ["kpi", "bucket"], "forecast_value", "actual_value"), "mae", "wape", "bias")


def tracking_impact(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    rows = tracking.against_actuals(_history(spark, sf_dir, daily), daily)
    per = lambda run: nowcast.horizon_metrics(rows.where(F.col("run_id") == run), ["kpi"], "forecast_value", "actual_value")
    return _round(nowcast.impact(per(f"run{LAST_RUN}"), per("run0"), ["kpi"]).join(nowcast.usage(per("run0")), "kpi"), "before", "after", "delta", "wape")


def consumption_daily(spark, sf_dir):
    return tracking.consumption(_history(spark, sf_dir), KPIS).select("target_date", "kpi", "forecast_value", "source")


def _yoy(spark, sf_dir, daily=None, history=None):
    daily = _daily(spark, sf_dir) if daily is None else daily
    history = _history(spark, sf_dir, daily) if history is None else history
    current = tracking.consumption(history, KPIS).select(F.col("target_date").alias("date"), "kpi", "forecast_value")
    return tracking.year_on_year_daily(tracking.full_year(spark, 2001, KPIS), daily, current, 1996), current


def consumption_year_daily(spark, sf_dir):
    return _round(_yoy(spark, sf_dir)[0], "diff_pct")


def quality_reference_coverage(spark, sf_dir):
    return _round(quality.reference_coverage(_yoy(spark, sf_dir)[0], [*KPIS, "items"]), "missing_pct")


def quality_reference_alignment(spark, sf_dir):
    compared, current = _yoy(spark, sf_dir)
    return quality.reference_alignment(current, compared, KPIS)


def _shown_weeks(spark, sf_dir, daily=None, history=None):
    daily = _daily(spark, sf_dir) if daily is None else daily
    history = _history(spark, sf_dir, daily) if history is None else history
    return tracking.consumption_weekly(history, KPIS, facts.actuals_weekly(daily))


def consumption_weekly(spark, sf_dir):
    return _shown_weeks(spark, sf_dir)


def consumption_reconciled(spark, sf_dir):
    days = tracking.consumption(_history(spark, sf_dir), KPIS).select(F.col("target_date").alias("date"), "kpi", F.col("forecast_value").alias("forecast"))
    daily, weekly = tracking.reconciled(days, {"both": KPIS})
    return daily.select(F.lit("day").alias("frequency"), "date", "kpi", "forecast").unionByName(weekly.select(F.lit("week").alias("frequency"), F.col("week").alias("date"), "kpi", "forecast"))


def _yoy_weekly(spark, daily, weeks):
    return tracking.year_on_year_weekly(tracking.full_year(spark, 2001, KPIS, weekly=True), facts.actuals_weekly(daily), 1997, weeks)


def consumption_year_weekly(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    return _round(_yoy_weekly(spark, daily, _shown_weeks(spark, sf_dir, daily)), "diff_pct")


def _progress(spark, sf_dir, daily=None, history=None):
    daily = _daily(spark, sf_dir) if daily is None else daily
    history = _history(spark, sf_dir, daily) if history is None else history
    plan = enrich.latest_before(history, ["kpi"], "forecast_value", "run_date", "target_date", "run_ts").withColumnRenamed("target_date", "date")
    rest = tracking.consumption(history, KPIS).select(F.col("target_date").alias("date"), "kpi", "forecast_value")
    return tracking.progress(spark, RUN, KPIS, plan, rest, daily, 1996)


#: KPI groups of cards and charts, and the quarters that are shown.
GROUPS, QUARTERS = {"lines": "picking_lines", "units": "picking_units"}, [1, 2]


def fact_cards(spark, sf_dir):
    compared, current = _yoy(spark, sf_dir)
    out = facts.cards(facts.group_points(current, compared, GROUPS, QUARTERS), [*GROUPS.values(), "services"])
    return _round(out, "forecast_delta", "reference_delta")


def fact_weekly_points(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    weeks = cut(_shown_weeks(spark, sf_dir, daily))
    return facts.group_points(weeks.withColumnRenamed("week", "date"), _yoy_weekly(spark, daily, weeks), {"lines": "picking", "units": "picking"}, QUARTERS)


def consumption_progress(spark, sf_dir):
    return _round(_progress(spark, sf_dir), "fulfilled", "diff_pct")


def consumption_checks(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    history = _history(spark, sf_dir, daily)
    compared, current = _yoy(spark, sf_dir, daily, history)
    weeks = cut(_shown_weeks(spark, sf_dir, daily, history))
    dimension = tracking.dim_kpi(spark, [("lines", "Lines", "lines", "picking"), ("units", "Units", "units", "picking")])
    out = tracking.validations(
        cut(current), weeks.withColumnRenamed("week", "date"), cut(compared), cut(_yoy_weekly(spark, daily, weeks)), _progress(spark, sf_dir, daily, history), daily, dimension, KPIS, 1996
    )
    return _round(out, "value")


def _graph(spark, sf_dir):
    items, _, scored = baskets._parts(spark, sf_dir)
    edges = cut(basket.graph_edges(scored, 0.18, baskets.LEAST))
    return items, edges, graph.clusters(edges)


def graph_components(spark, sf_dir):
    return graph.components(basket.graph_edges(baskets._scored(spark, sf_dir), 0.18, baskets.LEAST, baskets.STRONGEST))


def graph_clusters(spark, sf_dir):
    items, edges, members = _graph(spark, sf_dir)
    return graph.cluster_summary(edges, members, basket.item_metrics(items))


def graph_hubs(spark, sf_dir):
    return graph.hubs(*_graph(spark, sf_dir)[1:])


QUERIES = {
    f.__name__: f
    for f in (
        forecast_folds, forecast_seasonal_naive, forecast_baselines, forecast_weekly, forecast_weekly_fitted, forecast_backtest, forecast_backtest_naive, forecast_metrics, forecast_rank_baselines, forecast_ranking, forecast_next, forecast_next_baselines, forecast_ablations,
        forecast_ridge, forecast_features, nowcast_maturity, nowcast_scalers, nowcast_scalers_final, nowcast_blend, nowcast_postprocess, nowcast_transformer, nowcast_direct, nowcast_direct_metrics, forecast_replay, forecast_replay_report, forecast_replay_weekly, forecast_replay_weekly_report,
        tracking_history, tracking_split, tracking_weekly, tracking_errors, tracking_horizons, tracking_impact, consumption_daily, consumption_weekly, consumption_reconciled, consumption_year_daily, quality_reference_coverage, quality_reference_alignment, consumption_year_weekly, consumption_progress, fact_cards, fact_weekly_points, consumption_checks, graph_components, graph_clusters, graph_hubs,
    )
}

_DS = """WITH s AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS date, count(*)::DOUBLE AS target FROM orders GROUP BY ALL), b AS (SELECT series, min(date) AS a, max(date) AS z FROM s GROUP BY 1),
ds AS (SELECT g.series, g.date, coalesce(target, 0) AS target FROM (SELECT series, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS date FROM b) g LEFT JOIN s USING (series, date))"""
_FO = f"fo AS (SELECT series, (row_number() OVER (PARTITION BY series ORDER BY origin) - 1)::BIGINT AS fold, origin FROM (SELECT series, unnest(generate_series(DATE '{FOLD_START}', max(date) - INTERVAL {HORIZON} DAY, INTERVAL {STEP} DAY))::DATE AS origin FROM ds GROUP BY series))"
_WS = f"""WITH RECURSIVE w0 AS (SELECT o_orderpriority AS series, date_trunc('week', o_orderdate)::DATE AS date, count(*)::DOUBLE AS target FROM orders GROUP BY ALL), b AS (SELECT series, min(date) AS a, max(date) AS z FROM w0 GROUP BY 1),
ds AS (SELECT g.series, g.date, coalesce(target, 0) AS target FROM (SELECT series, unnest(generate_series(a, z, INTERVAL 7 DAY))::DATE AS date FROM b) g LEFT JOIN w0 USING (series, date)),
fo AS (SELECT series, (row_number() OVER (PARTITION BY series ORDER BY origin) - 1)::BIGINT AS fold, origin FROM (SELECT series, unnest(generate_series(date_trunc('week', DATE '{FOLD_START}'), max(date) - INTERVAL {7 * WEEKS} DAY, INTERVAL 7 DAY))::DATE AS origin FROM ds GROUP BY series))"""


def _naive(days: int, horizon: int, season: int) -> str:
    """Seasonal naive as tables: tk (usable values before each origin, latest first), fb (fallbacks) and sn."""
    step = f"{days} * " if days > 1 else ""
    return f"""tk AS MATERIALIZED (SELECT fo.series, fold, origin, date, target, row_number() OVER (PARTITION BY fo.series, fold ORDER BY date DESC) AS k FROM fo JOIN ds ON ds.series = fo.series AND date <= origin AND year(date) <> {LEFT_OUT}),
fb AS (SELECT series, fold, avg(target) AS mean FROM tk WHERE k <= {season} GROUP BY ALL),
sn AS (SELECT g.series, g.fold, g.origin, g.date, g.step, greatest(coalesce(v.target, mean, 0), 0) AS forecast FROM (SELECT series, fold, origin, (origin + ({step}h)::INT)::DATE AS date, h::INT AS step, (origin + ({step}(h - {season} * ceil(h / {season})))::INT)::DATE AS look FROM fo, range(1, {horizon + 1}) AS t(h)) g
LEFT JOIN ds v ON v.series = g.series AND v.date = look AND year(look) <> {LEFT_OUT} LEFT JOIN fb ON fb.series = g.series AND fb.fold = g.fold)"""


def _made(days: int, horizon: int, season: int, window: int) -> str:
    """Baselines as tables: those of `_naive`, mv and md."""
    step = f"{days} * " if days > 1 else ""
    put = lambda size, x: f"list_append(CASE WHEN len(tail) >= {size} THEN tail[2:] ELSE tail END, {x})"
    out = f"""{_naive(days, horizon, season)},
mv AS (SELECT series, fold, origin, 0 AS h, list(target ORDER BY date) AS tail, NULL::DOUBLE AS m FROM tk WHERE k <= {window} GROUP BY ALL UNION ALL SELECT series, fold, origin, h + 1, {put(window, 'list_avg(tail)')}, list_avg(tail) FROM mv WHERE h < {horizon})"""
    if days == 1:
        out += f""",
md AS (SELECT series, fold, origin, 0 AS h, list({{'w': isodow(date), 'v': target}} ORDER BY date) AS tail, NULL::DOUBLE AS m FROM tk WHERE k <= {histories.MEDIAN_OF} GROUP BY ALL
UNION ALL SELECT series, fold, origin, h + 1, {put(histories.MEDIAN_OF, "{'w': isodow(origin + h + 1), 'v': n}")}, n FROM (SELECT *, coalesce(list_median([x.v FOR x IN tail IF x.w = isodow(origin + h + 1)]), list_median([x.v FOR x IN tail])) AS n FROM md WHERE h < {horizon}))"""
    recursive = lambda name, model: f"SELECT series, fold, origin, '{model}', h, (origin + ({step}h)::INT)::DATE, greatest(m, 0) FROM {name} WHERE h > 0"
    return out + f""",
p AS (SELECT series, fold, origin, 'seasonal_naive' AS model, step, date, forecast AS y_pred FROM sn UNION ALL {recursive('mv', 'moving_average')} UNION ALL {recursive('md' if days == 1 else 'mv', 'median_weekday')}),
bl AS (SELECT p.series, fold::INT AS fold, origin, model, step::INT AS step, p.date, ds.target AS y_true, y_pred FROM p LEFT JOIN ds ON ds.series = p.series AND ds.date = p.date)"""


_BL = f"{_DS.replace('WITH', 'WITH RECURSIVE', 1)}, {_FO}, {_made(1, HORIZON, 7, 7)}"
_OOF = f"{_BL}, oof AS (SELECT *, sum(abs(y_true)) OVER w <> 0 AND y_true >= quantile_cont(y_true, 0.9) OVER w AS peak, CASE WHEN year(date) <= 2000 THEN 'ranking' ELSE 'stress' END AS view FROM bl WINDOW w AS (PARTITION BY series, fold, model))"
_ERRORS = "count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, sum(abs(y_pred - y_true)) / nullif(sum(abs(y_true)), 0) AS wape, avg(y_pred - y_true) AS bias"
_CALENDAR = ("month", "weekday", "iso_week", "week_of_month", "month_end", "holiday", "pre_holiday", "post_holiday", "bridge", "easter_days", "easter_week", "ramp_up")
_LOOK = (*[f"lag_{k}" for k in (7, 14, 28)], *[f"{f}_{k}" for k in (7, 14, 28) for f in ("mean", "median")], "mean_same_weekday")
_FE = f"""{_DS}, {_CAL}, fe0 AS (SELECT series, date, target, {', '.join([f'lag(target, {k}) OVER o AS lag_{k}' for k in (7, 14, 28)] + [f'avg(target) OVER {_FR(k)} AS mean_{k}, quantile_cont(target, 0.5) OVER {_FR(k)} AS median_{k}' for k in (7, 14, 28)])},
avg(target) OVER (PARTITION BY series, isodow(date) ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS mean_same_weekday FROM ds WINDOW o AS (PARTITION BY series ORDER BY date)),
fe AS MATERIALIZED (SELECT fe0.*, cal.* EXCLUDE (date), greatest(fe0.date - DATE '{RESTART}', 0) AS ramp_up FROM fe0 JOIN cal USING (date) WHERE lag_28 IS NOT NULL AND mean_same_weekday IS NOT NULL AND year(date) <> {LEFT_OUT})"""


def _ridge_sql() -> str:
    """Ridge by sums of products over the rows up to each origin, centred, and Gauss-Jordan elimination on lists."""
    names = [*_CALENDAR, *_LOOK]
    row = ", ".join(f"{n}::DOUBLE" for n in names)
    size = len(names)
    left = "UNION ALL ".join(f"SELECT 'ridge_no_{n}' AS model, {names.index(n) + 1} AS gone " for n in forecast.ABLATED)
    return f"""{_FE.replace('WITH', 'WITH RECURSIVE', 1)}, {_FO}, lf AS (SELECT * FROM fo QUALIFY row_number() OVER (PARTITION BY series ORDER BY fold DESC) <= {forecast.RECENT}),
xs AS (SELECT series, date, [{row}, 1, target] AS x FROM fe), bk AS (SELECT xs.series, x, (SELECT min(fold) FROM lf WHERE lf.series = xs.series AND origin >= date) AS fold FROM xs),
pr AS (SELECT series, fold, i, j, sum(x[i] * x[j]) AS g FROM bk, range(1, {size + 3}) AS a(i), range(1, {size + 3}) AS b(j) WHERE fold IS NOT NULL GROUP BY ALL),
gr AS (SELECT lf.series, lf.fold, i, j, sum(coalesce(g, 0)) OVER (PARTITION BY lf.series, i, j ORDER BY lf.fold) AS g FROM lf CROSS JOIN range(1, {size + 3}) AS a(i) CROSS JOIN range(1, {size + 3}) AS b(j) LEFT JOIN pr USING (series, fold, i, j)),
ce AS (SELECT m.series, m.fold, m.i, m.j, m.g - r.g * c.g / n.g AS g FROM gr m JOIN gr r ON r.series = m.series AND r.fold = m.fold AND r.i = m.i AND r.j = {size + 1} JOIN gr c ON c.series = m.series AND c.fold = m.fold AND c.i = {size + 1} AND c.j = m.j
JOIN gr n ON n.series = m.series AND n.fold = m.fold AND n.i = {size + 1} AND n.j = {size + 1} WHERE m.i <= {size} AND m.j <> {size + 1}),
mo AS (SELECT 'ridge' AS model, 0 AS gone UNION ALL {left}),
li AS (SELECT series, fold, model, gone, i, list(CASE WHEN i = gone OR j = gone THEN (i = j)::INT ELSE g + (i = j)::INT END ORDER BY j) AS line FROM ce CROSS JOIN mo GROUP BY ALL),
gj AS (SELECT series, fold, model, gone, 1 AS k, list(line ORDER BY i) AS m FROM li GROUP BY ALL
UNION ALL SELECT series, fold, model, gone, k + 1, [CASE WHEN q = k THEN [v / m[k][k] FOR v IN m[k]] ELSE [m[q][c] - m[q][k] / m[k][k] * m[k][c] FOR c IN range(1, {size + 2})] END FOR q IN range(1, {size + 1})] FROM gj WHERE k <= {size}),
sl AS (SELECT series, fold, model, unnest(range(1, {size + 1})) AS i, unnest([r[{size + 1}] FOR r IN m]) AS slope, gone FROM gj WHERE k = {size + 1}),
lv AS (SELECT sl.series, sl.fold, model, (max(t.g) - sum(slope * c.g)) / max(n.g) AS slope FROM sl JOIN gr c ON c.series = sl.series AND c.fold = sl.fold AND c.i = sl.i AND c.j = {size + 1} JOIN gr n ON n.series = sl.series AND n.fold = sl.fold AND n.i = {size + 1} AND n.j = {size + 1}
JOIN gr t ON t.series = sl.series AND t.fold = sl.fold AND t.i = {size + 1} AND t.j = {size + 2} GROUP BY ALL)
SELECT series, fold::INT AS fold, model, [{', '.join(f"'{n}'" for n in names)}][i] AS feature, round(slope, 4) AS slope FROM sl UNION ALL SELECT series, fold::INT, model, 'level', round(slope, 4) FROM lv"""


_HI = f"""WITH {CTES}, {_ACT}, runs AS (SELECT k::INT AS k, (DATE '{RUN_FROM}' + (7 * k)::INT)::DATE AS run FROM range(0, {LAST_RUN + 1}) AS t(k)), steps AS (SELECT k, run, (run + h::INT)::DATE AS d, (run + (h - 7 * ceil(h / 7))::INT)::DATE AS look FROM runs, range(1, {HORIZON + 1}) AS t(h)),
hi AS (SELECT 'run' || k AS run_id, k, run AS run_date, d AS target_date, v.kpi, v.actual_value AS forecast_value, al.actual_value, CASE WHEN d < DATE '2001-03-10' THEN 'notes' ELSE 'requests' END AS source FROM steps JOIN al v ON v.date = look AND v.kpi <> 'items' LEFT JOIN al ON al.date = d AND al.kpi = v.kpi)"""
_ERR = "er AS (SELECT run_id, target_date, kpi, forecast_value - actual_value AS error, abs(forecast_value - actual_value) AS abs_error, abs(forecast_value - actual_value) / nullif(abs(actual_value), 0) AS ape, (target_date - run_date)::INT AS horizon, actual_value FROM hi)"
_WA = "wp AS (SELECT run_id, kpi, sum(abs_error) / nullif(sum(abs(actual_value)), 0) AS wape FROM er GROUP BY ALL)"
_YD = f"""yd AS (SELECT d AS date, kpi, make_date(1996, month(d), least(day(d), day(last_day(make_date(1996, month(d), 1))))) AS reference_date FROM (SELECT unnest(generate_series(DATE '2001-01-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS d), (VALUES ('lines'), ('units')) AS k(kpi)),
yj AS (SELECT yd.date, yd.kpi, reference_date, a.actual_value AS actual, h.forecast_value AS forecast, r.actual_value AS reference FROM yd LEFT JOIN al a USING (date, kpi) LEFT JOIN hi h ON h.target_date = yd.date AND h.kpi = yd.kpi AND k = {LAST_RUN} LEFT JOIN al r ON r.date = reference_date AND r.kpi = yd.kpi)"""
_DIFF = "actual - reference AS diff, round((actual - reference) / nullif(reference, 0), 6) AS diff_pct"
_AW = "aw AS (SELECT date_trunc('week', date)::DATE AS date, kpi, sum(actual_value) AS actual FROM al WHERE kpi <> 'items' GROUP BY ALL)"
_CW = f"""cw AS (SELECT run_id, date_trunc('week', target_date)::DATE AS week, kpi, sum(forecast_value) AS forecast_value, count(*) AS days, ((date_trunc('week', target_date)::DATE - date_trunc('week', run_date)::DATE) / 7)::INT AS horizon_weeks,
CASE ((date_trunc('week', target_date)::DATE - date_trunc('week', run_date)::DATE) / 7)::INT WHEN 0 THEN NULL WHEN 1 THEN 'W+1' WHEN 2 THEN 'W+2' WHEN 3 THEN 'W+3_W+4' WHEN 4 THEN 'W+3_W+4' ELSE 'W+5' END AS bucket FROM hi WHERE k = {LAST_RUN} GROUP BY ALL)"""
_YW = """y0 AS (SELECT d AS date, kpi, CASE WHEN isoyear(date_trunc('week', DATE '1997-01-04') + INTERVAL (7 * (weekofyear(d) - 1)) DAY) = 1997 THEN (date_trunc('week', DATE '1997-01-04') + INTERVAL (7 * (weekofyear(d) - 1)) DAY)::DATE END AS reference_date FROM (SELECT unnest(generate_series(DATE '2001-01-01', DATE '2001-12-31', INTERVAL 7 DAY))::DATE AS d), (VALUES ('lines'), ('units')) AS k(kpi)),
yw AS (SELECT y0.date, y0.kpi, reference_date, a.actual, cw.forecast_value AS forecast, r.actual AS reference FROM y0 LEFT JOIN aw a USING (date, kpi) LEFT JOIN cw ON cw.week = y0.date AND cw.kpi = y0.kpi LEFT JOIN aw r ON r.date = reference_date AND r.kpi = y0.kpi)"""
_MAT = lambda most: f"mh AS (SELECT date, service_type, h::INT AS horizon, count(*) FILTER (lead_days >= h) / count(*) AS r FROM lv, range(0, {most + 1}) AS t(h) WHERE created_date IS NOT NULL GROUP BY ALL), mc AS (SELECT service_type, horizon, least(greatest(quantile_cont(r, 0.5), 0.05), 1.0)::DOUBLE AS visible FROM mh GROUP BY ALL)"
_SCL = "sa AS (SELECT date, service_type, count(*) FILTER (lines > 2) AS actual, count(*) AS due FROM lv GROUP BY ALL), scl AS (SELECT service_type, coalesce(quantile_cont(actual / due, 0.5), 1.0)::DOUBLE AS scaler FROM sa WHERE actual > 0 GROUP BY ALL)"
_WTS = "(VALUES " + ", ".join(f"('{k}', '{b}', {s}::DOUBLE, {c}::DOUBLE)" for (k, b), (s, c) in nowcast.WEIGHTS.items()) + ") AS wt(wk, wb, ws, wc)"

#: Daily series of services (as lower or upper case types) and picking in one table ds.
_BOTH = lambda name, kinds: f"""{_LV}, {_ACT}, s AS (SELECT {name} AS series, date, count(*)::DOUBLE AS target FROM lv WHERE lines > 2 {kinds} GROUP BY ALL UNION ALL SELECT kpi, date, actual_value FROM al WHERE kpi <> 'items'), b AS (SELECT series, min(date) AS a, max(date) AS z FROM s GROUP BY 1),
ds AS MATERIALIZED (SELECT g.series, g.date, coalesce(target, 0) AS target FROM (SELECT series, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS date FROM b) g LEFT JOIN s USING (series, date))"""  # noqa: E731
_DIR = f"""{_BOTH('service_type', '')}, fo AS (SELECT series, (row_number() OVER (PARTITION BY series ORDER BY origin) - 1)::BIGINT AS fold, origin FROM (SELECT series, unnest(generate_series(DATE '{FOLD_START}', max(date) - INTERVAL {HORIZON} DAY, INTERVAL {HORIZON} DAY))::DATE AS origin FROM ds GROUP BY series)), {_naive(1, HORIZON, 7)},
ur AS (SELECT regexp_extract(generic_code, '([0-9]+)$', 1) AS code, service_type, date, CASE WHEN lines > 4 THEN 'SI' ELSE 'NO' END AS urgency FROM lv), og AS (SELECT DISTINCT origin FROM fo WHERE series NOT IN ('lines', 'units')),
ma AS (SELECT service_type, urgency, code, (date - operational_date)::INT AS o, quantity, greatest(date, operational_date) AS day FROM ur JOIN (SELECT external_order_id AS code, operational_date, quantity FROM movements WHERE movement_type = 'PI' AND external_order_id IS NOT NULL) USING (code) WHERE date - operational_date BETWEEN 0 AND 60 AND year(operational_date) <> {LEFT_OUT}),
mk AS (SELECT og.origin, ma.* FROM og JOIN ma ON day <= origin), it AS (SELECT origin, service_type, urgency, count(*) / count(DISTINCT code) AS l, sum(quantity) / count(DISTINCT code) AS u FROM mk GROUP BY ALL), os AS (SELECT origin, service_type, urgency, o, count(*) / sum(count(*)) OVER (PARTITION BY origin, service_type, urgency) AS s FROM mk GROUP BY 1, 2, 3, 4),
mx AS (SELECT origin, service_type, urgency, count(*) / sum(count(*)) OVER (PARTITION BY origin, service_type) AS x FROM og JOIN ur ON date <= origin WHERE year(date) <> {LEFT_OUT} GROUP BY 1, 2, 3),
pf AS (SELECT sn.origin, (sn.date - o)::DATE AS date, sum(forecast * x * s * l) AS lines, sum(forecast * x * s * u) AS units FROM sn JOIN mx ON mx.origin = sn.origin AND mx.service_type = sn.series JOIN it ON it.origin = sn.origin AND it.service_type = sn.series AND it.urgency = mx.urgency JOIN os ON os.origin = sn.origin AND os.service_type = sn.series AND os.urgency = mx.urgency GROUP BY ALL),
dr AS (SELECT sn.origin, sn.series AS kpi, sn.date, ds.target AS y_true, forecast AS y_pred FROM sn JOIN og USING (origin) LEFT JOIN ds ON ds.series = sn.series AND ds.date = sn.date WHERE sn.series IN ('lines', 'units')),
di AS (SELECT *, 'direct' AS source FROM dr UNION ALL SELECT dr.origin, kpi, dr.date, y_true, coalesce(CASE kpi WHEN 'lines' THEN lines ELSE units END, 0), 'transformer' FROM dr LEFT JOIN pf USING (origin, date))"""
_REP = f"""{_BOTH('lower(service_type)', "AND service_type IN ('SGE', 'SGP', 'EGE')")}, fo AS (SELECT series, (run - DATE '{REPLAY_FROM}')::BIGINT AS fold, run AS origin FROM (SELECT DISTINCT series FROM ds), (SELECT unnest(generate_series(DATE '{REPLAY_FROM}', DATE '{REPLAY_TO}', INTERVAL 1 DAY))::DATE AS run)), {_naive(1, HORIZON, 7)}, {_MAT(HORIZON)}, {_SCL},
op AS (SELECT fo.origin, lv.date, service_type, count(*) AS n FROM lv JOIN (SELECT DISTINCT origin FROM fo) fo ON created_date <= origin AND origin <= lv.date GROUP BY ALL),
sg AS (SELECT origin, date, op.service_type, n / coalesce(visible, 1) * coalesce(scaler, 1) AS signal FROM op LEFT JOIN mc ON mc.service_type = op.service_type AND horizon = greatest(date - origin, 0) LEFT JOIN scl ON scl.service_type = op.service_type),
bs AS (SELECT sn.origin AS run_date, sn.date AS target_date, step AS horizon, CASE WHEN step = 1 THEN 'D+1' WHEN step <= 3 THEN 'D+2_D+3' WHEN step <= 7 THEN 'D+4_D+7' WHEN step <= 14 THEN 'D+8_D+14' ELSE 'D+15_D+28' END AS bucket, sn.series AS kpi, forecast AS base, signal, ds.target AS actual_value, sn.series NOT IN ('lines', 'units') AS service
FROM sn LEFT JOIN sg ON sg.origin = sn.origin AND sg.date = sn.date AND lower(sg.service_type) = sn.series LEFT JOIN ds ON ds.series = sn.series AND ds.date = sn.date),
we AS (SELECT 'before' AS variant, bs.*, CASE WHEN service THEN CASE WHEN horizon <= 7 THEN 0.35 ELSE 1 END::DOUBLE END AS statistical, CASE WHEN service THEN CASE WHEN horizon <= 7 THEN 0.65 ELSE 0 END::DOUBLE END AS backlog FROM bs
UNION ALL SELECT 'after', bs.*, CASE WHEN service THEN CASE WHEN horizon <= 7 THEN coalesce(ws, 0.35) ELSE 1 END::DOUBLE END, CASE WHEN service THEN CASE WHEN horizon <= 7 THEN coalesce(wc, 0.65) ELSE 0 END::DOUBLE END FROM bs LEFT JOIN {_WTS} ON wk = upper(kpi) AND wb = bucket),
bl AS (SELECT *, CASE WHEN service THEN base * statistical + coalesce(signal, base) * backlog ELSE base END AS v FROM we),
re AS (SELECT *, greatest(CASE WHEN variant = 'after' AND kpi IN ('sge', 'ege', 'lines') THEN round_even(v, 0) WHEN variant = 'after' AND kpi = 'units' THEN round_even(v + 500, 0) ELSE v END, 0)::DOUBLE AS forecast_value FROM bl)"""

ORACLES = {
    "forecast_folds": f"{_DS}, {_FO} SELECT * FROM fo",
    "forecast_seasonal_naive": f"{_BL} SELECT series, origin, date, step, round(forecast, 6) AS forecast FROM sn",
    "forecast_baselines": f"{_BL} SELECT * REPLACE (round(y_pred, 6) AS y_pred) FROM bl",
    "forecast_weekly": f"{_WS}, {_made(7, WEEKS, 52, 4)} SELECT * REPLACE (round(y_pred, 6) AS y_pred) FROM bl",
    "forecast_backtest_naive": f"{_OOF} SELECT series, fold, date, y_true, round(y_pred, 6) AS y_pred, peak, view FROM oof WHERE model = 'seasonal_naive'",
    "forecast_metrics": f"{_OOF}, e AS (SELECT series, fold, {_ERRORS}, avg(abs(y_pred - y_true)) FILTER (peak) AS mae_peak, sum(abs(y_pred - y_true)) FILTER (peak) / nullif(sum(abs(y_true)) FILTER (peak), 0) AS wape_peak FROM oof WHERE model = 'seasonal_naive' GROUP BY series, fold) SELECT series, fold, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(wape, 6) AS wape, round(bias, 6) + 0.0 AS bias, round(mae_peak, 6) AS mae_peak, round(wape_peak, 6) AS wape_peak FROM e",
    "forecast_rank_baselines": f"""{_OOF}, e AS (SELECT series, fold, model, {_ERRORS} FROM oof GROUP BY ALL), a AS (SELECT series, model, avg(mae) AS mean_mae, quantile_cont(mae, 0.5) AS median_mae, stddev_samp(mae) AS std_mae, avg(wape) AS mean_wape, avg(bias) AS mean_bias FROM e GROUP BY ALL),
w AS (SELECT series, model, quantile_cont(abs(y_pred - y_true), 0.9) AS p90_abs_error, avg(abs(y_pred - y_true)) FILTER (peak) AS mae_peak, sum(abs(y_pred - y_true)) FILTER (peak) / nullif(sum(abs(y_true)) FILTER (peak), 0) AS wape_peak FROM oof GROUP BY ALL)
SELECT series, model, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean_mae', 'median_mae', 'std_mae', 'mean_wape', 'mean_bias', 'p90_abs_error', 'mae_peak', 'wape_peak'))}, row_number() OVER (PARTITION BY series ORDER BY mean_wape NULLS LAST, mean_mae NULLS LAST, p90_abs_error, model)::INT AS rank FROM a JOIN w USING (series, model)""",
    "forecast_ridge": _ridge_sql(),
    "forecast_features": f"{_FE}, u AS (UNPIVOT (SELECT target, {', '.join(f'{n}::DOUBLE AS {n}' for n in (*_CALENDAR, *_LOOK))} FROM fe) ON {', '.join((*_CALENDAR, *_LOOK))} INTO NAME feature VALUE value) SELECT feature, count(*) AS n, round(avg(value), 5) AS mean, min(value) AS least, max(value) AS most, round(avg(value * target), 5) AS product FROM u GROUP BY feature",
    "nowcast_maturity": f"{_LV}, {_MAT(HORIZON)} SELECT service_type, horizon, round(visible, 6) AS visible FROM mc",
    "nowcast_scalers": f"{_LV}, {_SCL} SELECT service_type, round(scaler, 6) AS scaler FROM scl",
    "nowcast_blend": f"""{_LV}, {_MAT(14)}, {_SCL}, og AS (SELECT unnest(generate_series(DATE '1995-01-02', DATE '2001-06-25', INTERVAL 7 DAY))::DATE AS origin), op AS (SELECT origin, date, service_type, count(*) AS n FROM lv JOIN og ON created_date <= origin AND origin <= date GROUP BY ALL),
sg AS (SELECT origin, date, op.service_type, n / coalesce(visible, 1) * coalesce(scaler, 1) AS signal FROM op LEFT JOIN mc ON mc.service_type = op.service_type AND horizon = greatest(date - origin, 0) LEFT JOIN scl ON scl.service_type = op.service_type),
pf AS (SELECT origin, (origin + h::INT)::DATE AS date, service_type, h + 0.5::DOUBLE AS forecast, CASE WHEN h = 1 THEN 'D+1' WHEN h <= 3 THEN 'D+2_D+3' WHEN h <= 7 THEN 'D+4_D+7' ELSE 'D+8_D+14' END AS bucket, h FROM og, (SELECT DISTINCT service_type FROM lv), range(1, 15) AS t(h)),
bl AS (SELECT pf.*, CASE WHEN h <= 7 THEN coalesce(ws, 0.35) ELSE 1 END::DOUBLE AS statistical, CASE WHEN h <= 7 THEN coalesce(wc, 0.65) ELSE 0 END::DOUBLE AS backlog, signal FROM pf LEFT JOIN sg USING (origin, date, service_type) LEFT JOIN {_WTS} ON wk = service_type AND wb = bucket)
SELECT origin, date, service_type, forecast, bucket, statistical, backlog, round(forecast * statistical + coalesce(signal, forecast) * backlog, 6) AS blended FROM bl""",
    "nowcast_postprocess": f"WITH {CTES}, {_ACT}, v AS (SELECT date, kpi, actual_value * 1.25 - 3 AS f FROM al WHERE kpi <> 'items') SELECT date, kpi, greatest(CASE kpi WHEN 'lines' THEN round_even(greatest(f, 0), 0) ELSE round_even(least(greatest(f * 0.5 + 500, 0), 900), 0) END, 0)::DOUBLE AS forecast FROM v",
    "nowcast_transformer": f"""{_LV}, ur AS (SELECT regexp_extract(generic_code, '([0-9]+)$', 1) AS code, service_type, date, CASE WHEN lines > 4 THEN 'SI' ELSE 'NO' END AS urgency FROM lv),
ma AS (SELECT service_type, urgency, code, (date - operational_date)::INT AS o, quantity FROM ur JOIN (SELECT external_order_id AS code, operational_date, quantity FROM movements WHERE movement_type = 'PI' AND external_order_id IS NOT NULL) USING (code) WHERE date - operational_date BETWEEN 0 AND 60),
it AS (SELECT service_type, urgency, count(*) / count(DISTINCT code) AS l, sum(quantity) / count(DISTINCT code) AS u FROM ma GROUP BY 1, 2), os AS (SELECT service_type, urgency, o, count(*) / sum(count(*)) OVER (PARTITION BY service_type, urgency) AS s FROM ma GROUP BY 1, 2, 3),
mx AS (SELECT service_type, urgency, count(*) / sum(count(*)) OVER (PARTITION BY service_type) AS x FROM ur GROUP BY 1, 2), sv AS (SELECT date, service_type, count(*) AS f FROM lv GROUP BY ALL)
SELECT (date - o)::DATE AS pick_date, service_type, round(sum(f * x * s * l), 6) AS lines, round(sum(f * x * s * u), 6) AS units FROM sv JOIN mx USING (service_type) JOIN it USING (service_type, urgency) JOIN os USING (service_type, urgency) GROUP BY 1, 2""",
    "nowcast_direct": f"{_DIR} SELECT origin, kpi, date, source, y_true, round(y_pred, 6) AS y_pred FROM di",
    "nowcast_direct_metrics": f"""{_DIR}, dp AS (SELECT *, sum(abs(y_true)) OVER w <> 0 AND y_true >= quantile_cont(y_true, 0.9) OVER w AS peak FROM di WINDOW w AS (PARTITION BY origin, kpi, source)), e AS (SELECT kpi, origin, source, {_ERRORS}, avg(abs(y_pred - y_true)) FILTER (peak) AS mae_peak, sum(abs(y_pred - y_true)) FILTER (peak) / nullif(sum(abs(y_true)) FILTER (peak), 0) AS wape_peak FROM dp GROUP BY ALL)
SELECT kpi, origin, source, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(wape, 4) AS wape, round(mae_peak, 4) AS mae_peak, round(wape_peak, 4) AS wape_peak FROM e""",
    "forecast_replay": f"{_REP} SELECT variant, run_date, target_date, horizon, bucket, kpi, round(base, 4) AS base, round(signal, 4) AS signal, statistical, backlog, round(v, 4) AS blended, round(forecast_value, 4) AS forecast_value, actual_value, round(forecast_value - actual_value, 4) + 0.0 AS error, round(abs(forecast_value - actual_value), 4) AS abs_error FROM re",
    "forecast_replay_report": f"""{_REP}, er AS (SELECT *, forecast_value - actual_value AS e FROM re WHERE actual_value IS NOT NULL), me AS (SELECT variant, kpi, bucket, count(*) AS n, avg(abs(e)) AS mae, sum(abs(e)) / nullif(sum(abs(actual_value)), 0) AS wape, avg(e) AS bias, quantile_cont(abs(e), 0.5) AS median_error, quantile_cont(abs(e), 0.9) AS p90_error FROM er GROUP BY ALL),
j AS (SELECT kpi, bucket, {', '.join(f'b.{c} AS {c}_before, a.{c} AS {c}_after' for c in ('n', 'mae', 'wape', 'bias', 'median_error', 'p90_error'))}, {', '.join(f'a.{c} - b.{c} AS delta_{c}' for c in ('mae', 'wape', 'bias'))} FROM (FROM me WHERE variant = 'before') b JOIN (FROM me WHERE variant = 'after') a USING (kpi, bucket))
SELECT kpi, bucket, n_before, n_after, {', '.join(f'round({c}_{x}, 4) AS {c}_{x}' for c in ('mae', 'wape', 'bias', 'median_error', 'p90_error') for x in ('before', 'after'))}, {', '.join(f'round(delta_{c}, 4) AS delta_{c}' for c in ('mae', 'wape', 'bias'))},
CASE WHEN delta_mae <= -0.05 OR delta_wape <= -0.02 THEN 'helpful' WHEN delta_mae >= 0.05 OR delta_wape >= 0.02 THEN 'harmful' ELSE 'neutral' END AS impact FROM j""",
    "forecast_replay_weekly": f"{_REP}, aw AS (SELECT date_trunc('week', date)::DATE AS week, series AS kpi, sum(target) AS actual_value FROM ds GROUP BY ALL), fw AS (SELECT variant, run_date, kpi, date_trunc('week', target_date)::DATE AS week, sum(forecast_value) AS forecast_value FROM re GROUP BY ALL) SELECT variant, run_date, kpi, week, round(forecast_value, 4) AS forecast_value, actual_value, round(forecast_value - actual_value, 4) + 0.0 AS error FROM fw LEFT JOIN aw USING (week, kpi)",
    "tracking_history": f"{_HI} SELECT run_id, target_date, kpi, forecast_value, source, run_date FROM hi",
    "forecast_replay_weekly_report": f"""{_REP}, aw AS (SELECT date_trunc('week', date)::DATE AS week, series AS kpi, sum(target) AS actual_value FROM ds GROUP BY ALL), fw AS (SELECT variant, run_date, kpi, date_trunc('week', target_date)::DATE AS week, sum(forecast_value) AS forecast_value FROM re GROUP BY ALL),
er AS (SELECT *, forecast_value - actual_value AS e FROM fw JOIN aw USING (week, kpi)), me AS (SELECT variant, kpi, count(*) AS n, avg(abs(e)) AS mae, sum(abs(e)) / nullif(sum(abs(actual_value)), 0) AS wape, avg(e) AS bias, quantile_cont(abs(e), 0.5) AS median_error, quantile_cont(abs(e), 0.9) AS p90_error FROM er GROUP BY ALL),
j AS (SELECT kpi, {', '.join(f'b.{c} AS {c}_before, a.{c} AS {c}_after' for c in ('n', 'mae', 'wape', 'bias', 'median_error', 'p90_error'))}, {', '.join(f'a.{c} - b.{c} AS delta_{c}' for c in ('mae', 'wape', 'bias'))} FROM (FROM me WHERE variant = 'before') b JOIN (FROM me WHERE variant = 'after') a USING (kpi))
SELECT kpi, n_before, n_after, {', '.join(f'round({c}_{x}, 4) AS {c}_{x}' for c in ('mae', 'wape', 'bias', 'median_error', 'p90_error') for x in ('before', 'after'))}, {', '.join(f'round(delta_{c}, 4) AS delta_{c}' for c in ('mae', 'wape', 'bias'))},
CASE WHEN delta_mae <= -0.05 OR delta_wape <= -0.02 THEN 'helpful' WHEN delta_mae >= 0.05 OR delta_wape >= 0.02 THEN 'harmful' ELSE 'neutral' END AS impact FROM j""",
    "tracking_split": f"{_HI} SELECT run_id, target_date, kpi, source, CASE WHEN source = 'notes' THEN 'official' ELSE 'rest' END AS part FROM hi",
    "nowcast_scalers_final": f"""WITH fa AS ({SERVICE['fact_service_actuals']}), lr AS ({SERVICE['fact_requests']}), du AS (SELECT date, service_type, count(*) AS due FROM lr GROUP BY ALL)
SELECT upper(kpi) AS service_type, round(coalesce(quantile_cont(actual_value / due, 0.5), 1), 6) AS scaler FROM fa LEFT JOIN du ON du.date = fa.date AND du.service_type = upper(kpi) WHERE actual_truth = 'final' GROUP BY 1""",
    "tracking_weekly": f"{_HI} SELECT run_id, kpi, date_trunc('week', target_date)::DATE AS week, sum(forecast_value) AS forecast_value, count(*) AS days FROM hi GROUP BY ALL",
    "tracking_errors": f"{_HI}, {_ERR} SELECT run_id, target_date, kpi, error, abs_error, round(ape, 6) AS ape, horizon FROM er",
    "tracking_horizons": f"{_HI}, {_ERR}, bk AS (SELECT *, CASE WHEN horizon = 1 THEN 'D+1' WHEN horizon BETWEEN 2 AND 3 THEN 'D+2_D+3' WHEN horizon BETWEEN 4 AND 7 THEN 'D+4_D+7' WHEN horizon BETWEEN 8 AND 14 THEN 'D+8_D+14' WHEN horizon BETWEEN 15 AND 28 THEN 'D+15_D+28' END AS bucket FROM er) SELECT kpi, bucket, count(*) AS n, round(avg(abs_error), 6) AS mae, round(sum(abs_error) / nullif(sum(abs(actual_value)), 0), 6) AS wape, round(avg(error), 6) AS bias, quantile_cont(abs_error, 0.5) AS median_error, quantile_cont(abs_error, 0.9) AS p90_error FROM bk WHERE bucket IS NOT NULL GROUP BY kpi, bucket",
    "tracking_impact": f"{_HI}, {_ERR}, {_WA} SELECT kpi, round(b.wape, 6) AS before, round(a.wape, 6) AS after, round(a.wape - b.wape, 6) AS delta, CASE WHEN a.wape - b.wape < -0.01 THEN 'helpful' WHEN a.wape - b.wape > 0.01 THEN 'harmful' ELSE 'neutral' END AS impact, round(a.wape, 6) AS wape, CASE WHEN a.wape <= 0.35 THEN 'operational' WHEN a.wape <= 0.70 THEN 'indicative' ELSE 'exploratory' END AS use FROM wp a JOIN wp b USING (kpi) WHERE a.run_id = 'run0' AND b.run_id = 'run{LAST_RUN}'",
    "consumption_daily": f"{_HI} SELECT target_date, kpi, forecast_value, source FROM hi WHERE k = {LAST_RUN}",
    "consumption_year_daily": f"{_HI}, {_YD} SELECT date, kpi, reference_date, actual, forecast, reference, {_DIFF} FROM yj",
    "quality_reference_coverage": f"{_HI}, {_YD} SELECT k.kpi, count(date) AS rows, count(reference) AS known, sum(reference) AS total, min(date) AS first_date, max(date) AS last_date, count(date) - count(reference) AS missing, round(coalesce((count(date) - count(reference)) / nullif(count(date), 0), 0), 6) AS missing_pct, CASE WHEN count(reference) > 0 THEN 'ok' ELSE 'error' END AS status FROM (VALUES ('lines'), ('units'), ('items')) AS k(kpi) LEFT JOIN yj USING (kpi) GROUP BY k.kpi",
    "quality_reference_alignment": f"""{_HI}, {_YD}, f AS (SELECT kpi, quarter(target_date)::INT AS quarter, count(*) AS forecast_rows, sum(forecast_value) AS forecast_sum FROM hi WHERE k = {LAST_RUN} GROUP BY ALL), r AS (SELECT kpi, quarter(date)::INT AS quarter, count(*) AS reference_rows, count(reference) AS reference_known, sum(reference) AS reference_sum FROM yj GROUP BY ALL)
SELECT kpi, quarter, coalesce(forecast_rows, 0) AS forecast_rows, coalesce(forecast_sum, 0) AS forecast_sum, coalesce(reference_rows, 0) AS reference_rows, coalesce(reference_known, 0) AS reference_known, coalesce(reference_sum, 0) AS reference_sum, CASE WHEN reference_known > 0 THEN 'ok' ELSE 'error' END AS status
FROM (SELECT DISTINCT quarter FROM f) CROSS JOIN (VALUES ('lines'), ('units')) AS k(kpi) LEFT JOIN f USING (kpi, quarter) LEFT JOIN r USING (kpi, quarter)""",
    "consumption_weekly": f"{_HI}, {_AW}, {_CW} SELECT run_id, week, cw.kpi, forecast_value, days, horizon_weeks, bucket, 'daily_aggregated' AS source, actual AS actual_value, CASE WHEN actual IS NOT NULL THEN 'notes' END AS actual_source, CASE WHEN actual IS NOT NULL THEN 'final' END AS actual_truth FROM cw LEFT JOIN aw ON aw.date = week AND aw.kpi = cw.kpi",
    "consumption_reconciled": f"{_HI}, d AS (SELECT target_date AS date, kpi, forecast_value AS forecast FROM hi WHERE k = {LAST_RUN} UNION ALL SELECT target_date, 'both', sum(forecast_value) FROM hi WHERE k = {LAST_RUN} GROUP BY 1) SELECT 'day' AS frequency, date, kpi, forecast FROM d UNION ALL SELECT 'week', date_trunc('week', date)::DATE, kpi, sum(forecast) FROM d GROUP BY ALL",
    "consumption_year_weekly": f"{_HI}, {_AW}, {_CW}, {_YW} SELECT *, {_DIFF} FROM yw",
    "fact_cards": f"""{_HI}, {_YD}, g AS (SELECT 'picking_' || kpi AS "group", sum(actual) AS actual, sum(forecast) AS forecast, sum(reference) AS reference FROM yj WHERE year(date) = 2001 AND quarter(date) IN (1, 2) GROUP BY 1)
SELECT w.x AS "group", actual, forecast, reference, coalesce(actual, forecast, reference) AS headline, CASE WHEN actual IS NOT NULL THEN 'actual' WHEN forecast IS NOT NULL THEN 'forecast' WHEN reference IS NOT NULL THEN 'reference' ELSE 'none' END AS headline_from, round((actual - forecast) / nullif(abs(forecast), 0), 6) AS forecast_delta, round((actual - reference) / nullif(abs(reference), 0), 6) AS reference_delta
FROM (VALUES ('picking_lines'), ('picking_units'), ('services')) AS w(x) LEFT JOIN g ON g."group" = x""",
    "fact_weekly_points": f"""{_HI}, {_AW}, {_CW}, {_YW} SELECT date, 'picking' AS "group", sum(actual) AS actual, sum(forecast) AS forecast, sum(reference) AS reference FROM yw WHERE quarter(date) IN (1, 2) GROUP BY 1""",
    "consumption_progress": f"""{_HI}, pl AS (SELECT kpi, target_date AS date, arg_max(forecast_value, run_date) AS v FROM hi WHERE run_date < target_date GROUP BY ALL),
pe AS (SELECT * FROM (VALUES ('day', DATE '{RUN}', DATE '{RUN}'), ('week', date_trunc('week', DATE '{RUN}')::DATE, (date_trunc('week', DATE '{RUN}') + INTERVAL 6 DAY)::DATE), ('month', date_trunc('month', DATE '{RUN}')::DATE, last_day(DATE '{RUN}'))) AS p(period, "start", "end"), (VALUES ('lines'), ('units')) AS k(kpi)),
dd AS (SELECT period, "start", "end", kpi, unnest(generate_series("start", "end", INTERVAL 1 DAY))::DATE AS date FROM pe), de AS (SELECT *, date <= DATE '{RUN}' AS el, CASE WHEN period = 'week' THEN (date_trunc('week', DATE '1996-01-04') + INTERVAL (7 * (weekofyear(DATE '{RUN}') - 1)) DAY)::DATE + (isodow(date) - 1)::INT ELSE make_date(1996, month(date), day(date)) END AS rd FROM dd),
g AS (SELECT period, "start", "end", de.kpi, count(*) FILTER (el) AS expected_days, count(*) FILTER (el AND pl.v IS NOT NULL) AS planned_days, sum(pl.v) FILTER (el) AS p0, sum(a.actual_value) FILTER (el) AS actual, coalesce(sum(h.forecast_value) FILTER (NOT el), 0) AS rest, sum(r.actual_value) FILTER (el) AS reference
FROM de LEFT JOIN pl USING (date, kpi) LEFT JOIN al a USING (date, kpi) LEFT JOIN hi h ON h.target_date = de.date AND h.kpi = de.kpi AND k = {LAST_RUN} LEFT JOIN al r ON r.date = rd AND r.kpi = de.kpi GROUP BY ALL), q AS (SELECT * EXCLUDE (p0), CASE WHEN planned_days = expected_days THEN p0 END AS plan FROM g)
SELECT *, coalesce(CASE WHEN planned_days = expected_days THEN plan ELSE actual END, 0) + rest AS total, CASE WHEN planned_days = expected_days THEN 'plan and rest' ELSE 'actual and rest' END AS method, actual - plan AS gap, round(actual / nullif(plan, 0), 6) AS fulfilled, {_DIFF} FROM q""",
    "consumption_checks": f"""{_HI}, {_YD}, {_AW}, {_CW}, {_YW}, c AS (SELECT 'daily' AS name, date, kpi, reference_date, reference FROM yj UNION ALL SELECT 'weekly', date, kpi, reference_date, reference FROM yw), s AS (SELECT 'daily' AS name, target_date AS date, kpi FROM hi WHERE k = {LAST_RUN} UNION ALL SELECT 'weekly', week, kpi FROM cw),
kp AS (SELECT kpi, name, kpi IN (SELECT al.kpi FROM al WHERE year(date) = 1996) AS src FROM (VALUES ('lines'), ('units')) AS k(kpi), (VALUES ('daily'), ('weekly')) AS n(name)), lo AS (SELECT kp.name, kp.kpi, count(s.date) AS v FROM kp LEFT JOIN (SELECT * FROM s ANTI JOIN c USING (name, date, kpi)) s USING (name, kpi) GROUP BY ALL),
rf AS (SELECT kp.name, kp.kpi, coalesce(count(*) FILTER (reference_date IS NOT NULL AND reference IS NOT NULL) / nullif(count(*) FILTER (reference_date IS NOT NULL), 0), 1) AS v, count(reference_date) > 0 AND src AS due FROM kp LEFT JOIN c USING (name, kpi) GROUP BY kp.name, kp.kpi, src),
ch AS (SELECT 'daily_kpis' AS "check", 'all' AS kpi, (SELECT count(*) FROM (SELECT kpi FROM (SELECT DISTINCT kpi FROM hi WHERE k = {LAST_RUN}) FULL JOIN (VALUES ('lines'), ('units')) AS w(x) ON kpi = x WHERE kpi IS NULL OR x IS NULL))::DOUBLE AS value, 'warning' AS worst, 0 AS low, 0 AS high UNION ALL SELECT 'dimension_kpis', 'all', 0, 'warning', 0, 0 UNION ALL SELECT 'weekly_source', 'all', 0, 'error', 0, 0
UNION ALL SELECT 'progress_rows', 'all', 6, 'warning', 6, 6 UNION ALL SELECT name || '_coverage', 'all', avg((reference IS NOT NULL)::INT), 'warning', 0.95, 1 FROM c GROUP BY name UNION ALL SELECT name || '_duplicates', 'all', count(*) - count(DISTINCT (date, kpi)), 'error', 0, 0 FROM s GROUP BY name
UNION ALL SELECT name || '_forecast_without_row', 'all', sum(v), 'error', 0, 0 FROM lo GROUP BY name UNION ALL SELECT name || '_forecast_without_row', kpi, v, 'error', 0, 0 FROM lo)
SELECT "check", kpi, round(value, 6) AS value, CASE WHEN value BETWEEN low AND high THEN 'ok' ELSE worst END AS status FROM ch UNION ALL SELECT name || '_reference', kpi, round(v, 6), CASE WHEN NOT due THEN 'warning' WHEN v < 1 THEN 'error' ELSE 'ok' END FROM rf""",
    "graph_components": f"""{baskets._BASE.replace('WITH', 'WITH RECURSIVE', 1)}, {baskets._SC}, ge AS (SELECT article_a, article_b FROM sc WHERE layout_score >= 0.18 AND shared_transactions >= {baskets.LEAST} ORDER BY layout_score DESC, shared_transactions DESC, stability_score DESC, lift DESC, article_a, article_b LIMIT 4000),
bo AS (SELECT article_a AS x, article_b AS y FROM ge UNION ALL SELECT article_b, article_a FROM ge), re AS (SELECT x, y FROM bo UNION SELECT re.x, bo.y FROM re JOIN bo ON bo.x = re.y) SELECT x AS article, least(x, min(y)) AS component FROM re GROUP BY x""",
}
ORACLES["forecast_next_baselines"] = f"""{_DS.replace('WITH', 'WITH RECURSIVE', 1)}, fo AS (SELECT DISTINCT series, 0::BIGINT AS fold, DATE '{RUN}' AS origin FROM ds), {_made(1, HORIZON, 7, 7)}, rk AS ({ORACLES['forecast_rank_baselines']})
SELECT series, model, date, step, round(y_pred, 6) AS forecast FROM bl JOIN rk USING (series, model) WHERE rank = 1"""

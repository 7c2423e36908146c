"""Forecasts on histories with holes, exact splits, ridge by sums of products, and recursion, against plain code."""

import itertools
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from depotlane.operators import forecast, histories, learned
from depotlane.operators.policy import POLICY, Policy

START = date(2022, 1, 1)
OUT = 2023


def series(spark, days=1200, seed=4, names=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = [(n, START + timedelta(days=i), float(rng.poisson(5 + 3 * (i % 7 == 2)))) for n in names for i in range(days)]
    return spark.createDataFrame(rows, "series string, date date, target double"), pd.DataFrame(rows, columns=["series", "date", "target"])


def plain(model, known, future, season, window, weeks):
    """Step by step on a dict of dates: holes are dates that aren't there."""
    values, out = dict(known), []
    back = timedelta(days=season * (7 if weeks else 1))
    tail = [v for _, v in sorted(values.items())][-season:]
    for day in future:
        ordered = sorted(values.items())
        if model == "seasonal_naive":
            value = values.get(day - back, np.mean(tail))
        elif model == "moving_average" or weeks:
            value = np.mean([v for _, v in ordered[-window:]])
        else:
            same = [v for d, v in ordered[-histories.MEDIAN_OF :] if d.weekday() == day.weekday()]
            value = np.median(same or [v for _, v in ordered[-histories.MEDIAN_OF :]])
        values[day] = value
        out.append(max(value, 0.0))
    return out


@pytest.mark.parametrize("weeks", [False, True])
def test_baselines_with_a_hole(spark, weeks):
    df, frame = series(spark)
    frequency = histories.WEEKLY if weeks else histories.DAILY
    filled = histories.fill(histories.weekly(df) if weeks else df, frequency)
    frame = filled.toPandas()
    horizon = 6 if weeks else 20
    folded = histories.rolling(histories.dense(filled, [OUT]), "2022-12-20", horizon, 9, frequency)
    got = histories.baselines(folded, horizon, frequency=frequency).toPandas()
    assert {d.year for d in got.origin} == {2022, 2023, 2024, 2025}
    for (name, origin, model), rows in got.groupby(["series", "origin", "model"]):
        own = frame[frame.series == name]
        known = {d: v for d, v in zip(own.date, own.target) if d <= origin and d.year != OUT}
        rows = rows.sort_values("step")
        want = plain(model, known, list(rows.date), frequency.season, frequency.window, weeks)
        assert np.allclose(rows.y_pred, want), (name, origin, model)
        assert list(rows.date) == [origin + timedelta(days=frequency.days * (k + 1)) for k in range(horizon)]
        assert list(rows.y_true) == [own.target[own.date == d].iloc[0] for d in rows.date]


def test_short_and_empty_histories(spark):
    df = spark.createDataFrame([("s", date(2024, 1, 1), 4.0), ("s", date(2024, 1, 3), 1.0)], "series string, date date, target double")
    filled = histories.fill(df)
    assert sorted(r.target for r in filled.collect()) == [0.0, 1.0, 4.0]
    folded = histories.rolling(histories.dense(filled), "2024-01-01", 5, 1)
    assert histories.baselines(folded, 5).count() == 0  # no whole horizon is known
    runs = histories.run_dates(histories.dense(filled, [2024]), "2024-01-03", "2024-01-03")
    assert {r.y_pred for r in histories.baselines(runs, 3).collect()} == {0.0}  # nothing usable
    runs = histories.run_dates(histories.dense(filled), "2023-12-31", "2024-01-05")
    got = histories.baselines(runs, 2, ["seasonal_naive"])
    assert sorted({(r.fold, str(r.origin)) for r in got.collect()}) == [(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03"), (4, "2024-01-03"), (5, "2024-01-03")]
    assert histories.baselines(histories.rolling(histories.dense(histories.fill(df.limit(0))), "2024-01-01", 5, 1), 5).count() == 0


def best_split(x, y):
    """All splits of all columns, by their squared error."""
    best = (((y - y.mean()) ** 2).sum() - 1e-9, None, None)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for limit in (values[:-1] + values[1:]) / 2:
            side = x[:, k] <= limit
            error = sum(((part - part.mean()) ** 2).sum() for part in (y[side], y[~side]))
            if error < best[0] - 1e-9:
                best = (error, k, limit)
    return best[1:]


def grown(x, y, depth):
    k, limit = best_split(x, y) if depth and len(y) > 1 else (None, None)
    if k is None:
        return lambda z, m=y.mean(): np.full(len(z), m)
    side = x[:, k] <= limit
    low, high = grown(x[side], y[side], depth - 1), grown(x[~side], y[~side], depth - 1)
    return lambda z: np.where(z[:, k] <= limit, low(z), high(z))


@pytest.mark.parametrize("depth", [2, 3])
def test_boosting_takes_the_best_of_all_splits(depth):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=90), rng.integers(0, 4, 90), rng.normal(size=90), np.ones(90)])
    y = np.where(x[:, 0] > 0.3, 3.0, 0.0) + x[:, 1] * x[:, 2] + rng.normal(size=90)
    boosted = learned.Boosting(rounds=12, depth=depth, rate=0.3).fit(x, y)
    now, fresh = np.full(90, y.mean()), rng.normal(size=(50, 4))
    want = np.full(50, y.mean())
    for _ in range(12):
        tree = grown(x, y - now, depth)
        now, want = now + 0.3 * tree(x), want + 0.3 * tree(fresh)
    assert np.allclose(boosted.predict(x), now)
    assert depth == 3 or np.allclose(boosted.predict(fresh), want)  # deep nodes hold few rows, which several columns split alike
    assert all(b <= a + 1e-12 for a, b in itertools.pairwise(boosted.losses))
    assert np.allclose(learned.Boosting(5).fit(np.ones((4, 2)), np.arange(4.0)).predict(np.ones((1, 2))), 1.5)


def calendar(spark, first=START, days=1300):
    days = [first + timedelta(days=i) for i in range(days)]
    rows = [(d, d.weekday(), (d.day - 1) // 7 + 1, d.month, int(d.month == 4), max((d - date(2024, 1, 1)).days, 0)) for d in days]
    return spark.createDataFrame(rows, "date date, weekday int, week_of_month int, month int, easter_week int, ramp_up int")


def test_ridge_equals_least_squares_on_each_fold(spark):
    df, _ = series(spark, 900)
    filled = histories.fill(df)
    rows, names, _ = forecast.features(filled, calendar(spark), exclude_years=[OUT])
    folded = histories.rolling(histories.dense(filled, [OUT]), "2022-06-01", 14, 50)
    folds = histories.fold_table(folded)
    variants = forecast.variants("ridge", ["week_of_month", "ramp_up"])
    got = learned.ridge(learned.grams(rows, folds, names, 50, histories.DAILY), names, variants).collect()
    table = rows.where("usable").toPandas()
    origins = {(r.series, r.fold): r.origin for r in folds.collect()}
    assert len(got) == len(origins) * 3 > 30
    for r in got:
        train = table[(table.series == r.series) & (table.date <= origins[r.series, r.fold])]
        assert not any(d.year == OUT for d in train.date)
        kept = [n for n in names if n not in variants[r.model]]
        x = np.column_stack([train[kept].to_numpy(float), np.ones(len(train))])
        want = np.linalg.solve(x.T @ x + np.diag([1.0] * len(kept) + [0.0]), x.T @ train.target.to_numpy())
        have = dict(zip([*names, "level"], r.slopes))
        assert np.allclose([have[n] for n in [*kept, "level"]], want, atol=1e-6) and all(have[n] == 0 for n in variants[r.model])


def step_by_step(known, future, names, days, weight, frequency):
    """The forecast of one linear rule, features rebuilt from a dict of dates."""
    values, out = dict(known), []
    unit = timedelta(days=frequency.days)
    for day in future:
        ordered = [v for _, v in sorted(values.items())]
        made = {f"lag_{k}": values.get(day - k * unit, 0.0) for k in frequency.lags}
        for w in frequency.windows:
            made |= {f"mean_{w}": np.mean(ordered[-w:]), f"median_{w}": np.median(ordered[-w:])}
        same = [v for d, v in sorted(values.items()) if d.weekday() == day.weekday()][-4:]
        made["mean_same_weekday"] = np.mean(same) if same else 0.0
        x = np.array([made[n] if n in made else days[day][n] for n in names], float)
        values[day] = min(max(float(x @ weight), 0.0), learned.TOP)
        out.append(values[day])
    return out


@pytest.mark.parametrize("weeks", [False, True])
def test_recursion_rebuilds_features_by_date(spark, weeks):
    df, _ = series(spark, 1150, names=("a",))
    frequency = histories.WEEKLY if weeks else histories.DAILY
    filled = histories.fill(histories.weekly(df) if weeks else df, frequency)
    first = filled.agg({"date": "min"}).first()[0]
    days = calendar(spark, first, 1300).where("weekday = 0") if weeks else calendar(spark, first)
    horizon = 9
    folded = histories.rolling(histories.dense(filled, [OUT]), "2023-12-28", horizon, 5, frequency)
    _, names, own = forecast.features(filled, days, frequency, [OUT])
    weight = np.random.default_rng(1).normal(size=len(names)) * 0.1
    slopes = histories.fold_table(folded, frequency).selectExpr("series", "fold", "'m' as model", "array({}) as slopes".format(", ".join(f"cast({w} as double)" for w in [*weight, 0.0])))
    got = learned.by_ridge(learned.states(folded, horizon, frequency), slopes, names, days, own, horizon, frequency).toPandas()
    at = {r.date: r.asDict() for r in days.collect()}
    known = filled.toPandas()
    assert got.origin.nunique() > 3
    for origin, rows in got.groupby("origin"):
        history = {d: v for d, v in zip(known.date, known.target) if d <= origin and d.year != OUT}
        rows = rows.sort_values("step")
        assert np.allclose(rows.y_pred, step_by_step(history, list(rows.date), names, at, weight, frequency)), origin


def test_backtest_and_next(spark):
    df, _ = series(spark, 700, names=("a", "b"))
    filled, days = histories.fill(df), calendar(spark)
    got = forecast.backtest(filled, days, "2023-10-01", 7, 14, ["seasonal_naive", "ridge", "boosting"], ablate=["ramp_up"], recent=2).cache()
    folds = got.select("fold").distinct().count()
    count = {(r.series, r.model): r["count"] for r in got.groupBy("series", "model").count().collect()}
    assert folds == 4 and count["a", "ridge"] == count["b", "boosting"] == 28 and count["a", "ridge_no_ramp_up"] == count["a", "boosting_no_ramp_up"] == 14
    assert got.where("y_pred < 0 or y_true is null").count() == 0
    ranked = forecast.summarize(forecast.out_of_fold(got))
    chosen = forecast.best_model(ranked.where("series = 'a'"), df)
    assert {r.series: r.model for r in chosen.collect()}["b"] == "seasonal_naive"
    made = forecast.forecast(filled, days, chosen, "2023-11-20", 5)
    assert sorted((r.series, r.step) for r in made.collect()) == [(s, k) for s in "ab" for k in range(1, 6)]
    assert str(made.agg({"date": "min"}).first()[0]) == "2023-11-21"
    named = spark.createDataFrame([("a", "ridge_no_ramp_up")], "series string, model string")
    assert {r.model for r in forecast.forecast(filled, days, named, "2023-11-20", 5).collect()} == {"ridge_no_ramp_up"}
    assert forecast.forecast(filled, days, named.limit(0), "2023-11-20", 5).count() == 0
    with pytest.raises(ValueError, match="no such model"):
        forecast.forecast(filled, days, spark.createDataFrame([("a", "trend")], "series string, model string"), "2023-11-20", 5)


def test_policy(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3, 4, 5)], "lag_7 int, target double, month string, weekday int, flag_x int, other int")
    assert POLICY.select(df) == ["lag_7", "weekday"] and POLICY.select(df, ["weekday"]) == ["lag_7"]
    with pytest.raises(ValueError, match="blocked"):
        POLICY.check(["lag_7", "target_rate"])
    with pytest.raises(ValueError, match="not allowed"):
        POLICY.check(["other"])
    own = Policy(allow=("other",), block_prefixes=("lag_",))
    assert own.select(df) == ["other"] and not own.allowed("lag_7")

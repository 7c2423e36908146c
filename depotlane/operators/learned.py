"""Forecasts by fitted models: ridge from sums of products, boosted trees with exact splits, recursion.

The training table has one row for each series and period, made by Spark's windows; features that look back take
the series as it is, excluded years included, and rows of excluded years don't train.

Ridge: products of features are summed by the first fold that may use a row; sums over earlier folds
are prefix sums, so every fold's normal equations come from one pass over the rows, and a
feature is left out by leaving out its row and column.

Boosting: one task fits the folds of a block of one series, which share the sorted columns.

Forecasts go step by step: features that look back are rebuilt from what is usable up to the
origin and from earlier steps. What a lag finds in a hole counts as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from depotlane.operators.calendar import add_lags
from depotlane.operators.histories import Frequency, last, let, points, tail

TOP = 1e9
ALPHA = 1.0
#: Folds of one series that a task of boosted trees fits.
BLOCK = 4


def lag_names(frequency: Frequency) -> list[str]:
    """The names of the features that look back."""
    return [*[f"lag_{k}" for k in frequency.lags], *[f"{s}_{w}" for w in frequency.windows for s in ("mean", "median")], *(["mean_same_weekday"] if frequency.days == 1 else [])]


def training(filled: DataFrame, calendar: DataFrame, frequency: Frequency, exclude_years: Sequence[int] = (), key: str = "series") -> DataFrame:
    """(series, date, target, all features, usable): usable rows have every feature and lie in no excluded year.

    calendar: date and numbers, one row for each date (a few thousand).
    """
    rows = add_lags(filled.select(key, "date", F.col("target").cast("double").alias("target")), frequency.lags, frequency.windows, key=key)
    if frequency.days != 1:
        rows = rows.drop("mean_same_weekday")
    rows = rows.join(F.broadcast(calendar), "date", "left")
    names = [c for c in rows.columns if c not in (key, "date", "target")]
    whole = F.array(*[F.col(c).isNotNull() for c in names])
    return rows.withColumn("usable", ~F.array_contains(whole, False) & ~F.year("date").isin(*exclude_years) if exclude_years else ~F.array_contains(whole, False))


def grams(rows: DataFrame, folds: DataFrame, names: Sequence[str], step: int, frequency: Frequency, key: str = "series") -> DataFrame:
    """(series, fold, i, products): for feature i the sums of its products with each feature, over the fold's training rows.

    Features are `names`, then 1, then the target. folds: (series, fold, at, origin), `step` periods apart.
    """
    x = F.array(*[F.col(c).cast("double") for c in names], F.lit(1.0), F.col("target"))
    size = len(names) + 2
    begin = folds.groupBy(key).agg(F.min("origin").alias("begin"), F.min("fold").alias("base"), F.max("fold").alias("folds"))
    own = rows.where("usable").join(begin, key)  # folds that may use a row are those from its bucket on
    bucket = F.greatest(F.ceil(F.datediff("date", "begin") / (step * frequency.days)), F.lit(0)).cast("int")
    own = own.select(key, (bucket + F.col("base")).alias("fold"), x.alias("x"), "folds").where("fold <= folds")
    sums = own.select(key, "fold", "x", F.posexplode("x").alias("i", "v")).groupBy(key, "fold", "i").agg(*[F.sum(F.col("v") * F.col("x")[j]).alias(f"g{j}") for j in range(size)])
    grid = folds.select(key, "fold", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i"))
    so_far = Window.partitionBy(key, "i").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(sums, [key, "fold", "i"], "left")
    return out.select(key, "fold", "i", F.array(*[F.sum(F.coalesce(f"g{j}", F.lit(0.0))).over(so_far) for j in range(size)]).alias("products"))


def solve(products: np.ndarray, keep: Sequence[int], alpha: float = ALPHA) -> np.ndarray:
    """Slopes of all features (0 of those not kept) and the level, from sums of products: a penalty on slopes alone."""
    size = len(products) - 2
    out, n = np.zeros(size + 1), products[size, size]
    if n > 0:
        keep = list(keep)
        mean, level = products[size, keep] / n, products[size, size + 1] / n
        square = products[np.ix_(keep, keep)] - n * np.outer(mean, mean) + alpha * np.eye(len(keep))
        out[keep] = np.linalg.solve(square, products[keep, size + 1] - n * mean * level)
        out[size] = level - mean @ out[keep]
    return out


def ridge(summed: DataFrame, names: Sequence[str], variants: Mapping[str, Sequence[str]], key: str = "series") -> DataFrame:
    """(series, fold, model, slopes): coefficients of each variant (name: features left out), the level last."""
    matrix = summed.groupBy(key, "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "products"))), lambda r: r["products"]).alias("m"))
    kept = {model: [k for k, n in enumerate(names) if n not in dropped] for model, dropped in variants.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, f, model, solve(np.stack(m), keep).tolist()) for k, f, m in zip(frame[key], frame.fold, frame.m) for model, keep in kept.items()]
            yield pd.DataFrame(rows, columns=[key, "fold", "model", "slopes"])

    return matrix.mapInPandas(run, f"{key} string, fold int, model string, slopes array<double>")


class Boosting:
    """Boosted regression trees: squared loss, the best of all splits between distinct values.

    Each column is sorted once; a node's splits are prefix sums over the column's distinct values. Trees
    are whole heaps of `depth` levels, with a node that isn't split repeated below.
    """

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.05):
        self.rounds, self.depth, self.rate = rounds, depth, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        n, width = x.shape
        values, bins = zip(*[np.unique(x[:, k], return_inverse=True) for k in range(width)]) if width else ((), ())
        starts = np.cumsum([0, *map(len, values)])
        flat = np.stack([b + s for b, s in zip(bins, starts)]) if width else np.empty((0, n), np.int64)
        values = np.concatenate(values) if width else np.empty(0)
        inner, leaves = 2**self.depth, 2**self.depth
        self.start = y.mean() if n else 0.0
        self.feature, self.limit, self.leaf = np.zeros((self.rounds, inner), np.int64), np.full((self.rounds, inner), np.inf), np.zeros((self.rounds, leaves))
        now, self.losses = np.full(n, self.start), []
        for t in range(self.rounds):
            node, residual = np.ones(n, np.int64), y - now
            for level in range(self.depth):
                self._split(t, level, node, residual, flat, values, starts)
                node = 2 * node + (x[np.arange(n), self.feature[t, node]] > self.limit[t, node]) if n and width else 2 * node
            count = np.bincount(node - leaves, minlength=leaves)
            self.leaf[t] = np.bincount(node - leaves, residual, leaves) / np.maximum(count, 1)
            now = now + self.rate * self.leaf[t, node - leaves]
            self.losses.append(float(((y - now) ** 2).mean()) if n else 0.0)
        return self

    def _split(self, t: int, level: int, node: np.ndarray, residual: np.ndarray, flat: np.ndarray, values: np.ndarray, starts: np.ndarray) -> None:
        first, total = 2**level, len(values)
        at = (flat + (node - first) * total).ravel()
        count = np.bincount(at, minlength=first * total).reshape(first, total)
        part = np.bincount(at, np.broadcast_to(residual, flat.shape).ravel(), first * total).reshape(first, total)
        own, whole = np.bincount(node - first, minlength=first)[:, None], np.bincount(node - first, residual, first)[:, None]
        left, upto = np.cumsum(count, axis=1), np.cumsum(part, axis=1)
        column = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        left, upto = left - column * own, upto - (np.concatenate([np.zeros((first, 1)), upto], axis=1)[:, starts[:-1]])[:, column]
        right = own - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((count > 0) & (right > 0), upto**2 / left + (whole - upto) ** 2 / right - whole**2 / own, 0.0)
        for k, j in enumerate(gain.argmax(axis=1)) if total else ():
            if gain[k, j] > 1e-12:
                above = j + 1 + int((count[k, j + 1 :] > 0).argmax())  # the next value that the node holds
                self.feature[t, first + k], self.limit[t, first + k] = column[j], (values[j] + values[above]) / 2

    def predict(self, x: np.ndarray) -> np.ndarray:
        node, trees = np.ones((len(x), self.rounds), np.int64), np.arange(self.rounds)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x))[:, None], self.feature[trees, node]] > self.limit[trees, node])
        return self.start + self.rate * self.leaf[trees, node - 2**self.depth].sum(axis=1)


def states(histories: DataFrame, horizon: int, frequency: Frequency, key: str = "series") -> DataFrame:
    """What a recursion needs of each fold: series, first, fold, at, lags, tail, same (by weekday) and t (what came).

    lags: the last values by date, null where unusable; tail: the last usable values; same: the last four usable
    values of each weekday from Monday on.
    """
    longest, widest = max(frequency.lags), max(frequency.windows)
    numbers = lambda a: F.transform(a, lambda x: x["v"])

    def fold(f: Column) -> Column:
        at = f["at"]
        by_place = F.map_from_entries(F.filter("known", lambda x: (x["i"] <= at) & (x["i"] > at - longest)))
        lags = let(by_place, lambda m: F.transform(F.sequence(at - longest + 1, at), lambda i: F.try_element_at(m, i)))
        weekday = lambda x: F.pmod(F.weekday("first") + x["i"], F.lit(7))
        same = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda w: numbers(last(F.filter("known", lambda x: (x["i"] <= at) & (weekday(x) == w)), 4))) if frequency.days == 1 else F.array().cast("array<array<double>>")
        return F.struct(f["fold"].alias("fold"), at.alias("at"), lags.alias("lags"), numbers(tail(at, widest)).alias("tail"), same.alias("same"), F.slice("values", at + 2, horizon).alias("t"))

    return histories.select(key, "first", F.explode(F.transform("folds", fold)).alias("s")).select(key, "first", "s.*")


@dataclass(frozen=True)
class Dates:
    """Calendar features by date, on the driver: a row for each of a few thousand dates."""

    first: np.datetime64
    days: int
    rows: np.ndarray

    @staticmethod
    def of(calendar: DataFrame, names: Sequence[str], frequency: Frequency) -> Dates:
        frame = calendar.select("date", *[F.col(n).cast("double") for n in names]).orderBy("date").toPandas()
        dates = frame.date.to_numpy().astype("datetime64[D]")
        if len(dates) and not (np.diff(dates) == np.timedelta64(frequency.days, "D")).all():
            raise ValueError("the calendar must have every period once")
        return Dates(dates[0] if len(dates) else np.datetime64("1970-01-01"), frequency.days, frame[list(names)].to_numpy(float))

    def at(self, dates: np.ndarray) -> np.ndarray:
        return self.rows[(dates - self.first).astype(int) // self.days]


def _padded(lists: Sequence[Sequence[float]], size: int) -> np.ndarray:
    """Lists at the right of rows of `size`, nan before them and for nulls."""
    out = np.full((len(lists), size), np.nan)
    for row, values in zip(out, lists):
        if len(values):
            row[size - len(values) :] = np.asarray(values, float)
    return out


def recurse(frame: pd.DataFrame, names: Sequence[str], dates: Dates, calendar_names: Sequence[str], horizon: int, frequency: Frequency, score: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """`horizon` forecasts for each row of states; `score` predicts from a matrix of features, one row each."""
    count = len(frame)
    lags, tails = _padded(frame.lags, max(frequency.lags)), _padded(frame["tail"], max(frequency.windows))
    same = np.stack([_padded(s, 4) for s in frame.same]) if frequency.days == 1 and count else None
    origin = frame["first"].to_numpy().astype("datetime64[D]") + frame["at"].to_numpy() * np.timedelta64(frequency.days, "D")
    place = {n: k for k, n in enumerate(calendar_names)}
    out, each = np.zeros((count, horizon)), np.arange(count)
    for step in range(horizon if count else 0):
        date = origin + np.timedelta64((step + 1) * frequency.days, "D")
        days, weekday = dates.at(date), (date.astype(int) + 3) % 7
        made = {f"lag_{k}": lags[:, -k] for k in frequency.lags}
        with np.errstate(all="ignore"):
            for w in frequency.windows:
                part = tails[:, -w:]
                held = ~np.isnan(part)
                made[f"mean_{w}"] = np.where(held, part, 0).sum(axis=1) / held.sum(axis=1)
                ordered, n = np.sort(part, axis=1), held.sum(axis=1)  # nan sorts last
                made[f"median_{w}"] = (ordered[each, np.maximum(n - 1, 0) // 2] + ordered[each, np.minimum(n // 2, part.shape[1] - 1)]) / 2
            if same is not None:
                part = same[each, weekday]
                made["mean_same_weekday"] = np.nansum(part, axis=1) / (~np.isnan(part)).sum(axis=1)
        x = np.nan_to_num(np.column_stack([made[n] if n in made else days[:, place[n]] for n in names]), nan=0.0, posinf=0.0, neginf=0.0)
        out[:, step] = np.clip(score(x), 0.0, TOP)
        lags = np.column_stack([lags[:, 1:], out[:, step]])
        tails = np.column_stack([tails[:, 1:], out[:, step]])
        if same is not None:
            same[each, weekday] = np.column_stack([same[each, weekday][:, 1:], out[:, step]])
    return out


_POINTS = "{key} string, first date, fold int, at int, model string, p array<double>, t array<double>"


def _made(frame: pd.DataFrame, model: Sequence[str], made: np.ndarray, key: str) -> pd.DataFrame:
    return pd.DataFrame({key: frame[key], "first": frame["first"], "fold": frame.fold, "at": frame["at"], "model": model, "p": list(made), "t": frame.t})


def by_ridge(state: DataFrame, slopes: DataFrame, names: Sequence[str], calendar: DataFrame, calendar_names: Sequence[str], horizon: int, frequency: Frequency, key: str = "series") -> DataFrame:
    """Forecasts of every fold and ridge variant: (series, fold, origin, model, step, date, y_true, y_pred)."""
    dates = Dates.of(calendar, calendar_names, frequency)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                b = np.stack(frame.slopes.to_list())
                made = recurse(frame, names, dates, calendar_names, horizon, frequency, lambda x, b=b: np.einsum("ij,ij->i", x, b[:, :-1]) + b[:, -1])
                yield _made(frame, frame.model, made, key)

    return points(state.join(slopes, [key, "fold"]).mapInPandas(run, _POINTS.format(key=key)), frequency, key)


def by_boosting(
    state: DataFrame, rows: DataFrame, names: Sequence[str], variants: Mapping[str, Sequence[str]], calendar: DataFrame, calendar_names: Sequence[str], horizon: int, frequency: Frequency,
    recent: Mapping[str, int] | None = None, key: str = "series", block: int = BLOCK, rounds: int = 120,
) -> DataFrame:
    """Forecasts of every fold by boosted trees, fitted on the rows up to its origin.

    variants: model name and features left out; `recent` names variants that only the last so many folds get.
    A task holds the training rows of one series (one for each period) and at most `block` of its folds.
    """
    dates, recent = Dates.of(calendar, calendar_names, frequency), dict(recent or {})
    x = F.array(*[F.col(n).cast("double") for n in names])
    table = rows.where("usable").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", F.col("target").alias("y"), x.alias("x")))).alias("table"))
    last_fold = Window.partitionBy(key)
    part = state.withColumn("folds", F.max("fold").over(last_fold) + 1).withColumn("block", F.floor(F.col("fold") / block))
    own = [F.struct(*[F.col(c) for c in ("first", "fold", "at", "lags", "tail", "same", "t", "folds")]).alias("s")]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given keeps Spark from merging the few bytes of much work
    parts = part.groupBy(key, "block").agg(F.collect_list(own[0]).alias("states")).join(table, key).repartition(tasks, key, "block")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for series, held, train in zip(frame[key], frame.states, frame.table):
                day = np.array([r["date"] for r in train], "datetime64[D]")
                features, y = np.stack([r["x"] for r in train]), np.array([r["y"] for r in train])
                for s in held:
                    one = pd.DataFrame([dict(s)]).assign(**{key: series})
                    now = day <= np.datetime64(s["first"], "D") + s["at"] * np.timedelta64(frequency.days, "D")
                    for model, dropped in variants.items():
                        if s["fold"] >= s["folds"] - recent.get(model, s["folds"]):
                            keep = [k for k, n in enumerate(names) if n not in dropped]
                            trees = Boosting(rounds).fit(features[now][:, keep], y[now])
                            made = recurse(one, [names[k] for k in keep], dates, calendar_names, horizon, frequency, trees.predict)
                            yield _made(one, [model], made, key)

    return points(parts.mapInPandas(run, _POINTS.format(key=key)), frequency, key)

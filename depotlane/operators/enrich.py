"""Filling and joining tables by keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def unambiguous(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each complete key that stands for one set of values only (null being a value)."""
    whole = df
    for k in keys:
        whole = whole.where(F.col(k).isNotNull())
    own = F.struct(*values)
    out = whole.groupBy(*keys).agg(F.min(own).alias("_least"), F.max(own).alias("_most")).where(F.col("_least").eqNullSafe(F.col("_most")))
    return out.select(*keys, "_least.*")


#: What a movement is looked up by, and what a lookup fills.
LOOKUP_KEYS = ("pallet", "sku", "completed_at", "quantity", "owner")
LOOKUP_FILL = ("order_id", "external_order_id", "client", "external_client")


def fill_orders(movements: DataFrame, lookup: DataFrame, keys: Sequence[str] = LOOKUP_KEYS, fill: Sequence[str] = LOOKUP_FILL, order: str = "external_order_id") -> DataFrame:
    """Fills picks without an order from a lookup: every column of `fill` that is null, with `enriched` and `source`.

    Lookup rows without an order or a key don't count, and keys that stand for different values are
    dropped, so that no movement multiplies. Only picks without an order and with all keys are looked up. `source`
    is source, lookup, or null without an order. Columns of `fill` that either table lacks are left alone.

    Both tables are dealt by the keys together, once, and each is read once: nothing is filtered before, which would
    repeat the reading of text below. Rows that don't take part lie apart, so that missing keys don't meet in one task.
    """
    fill = [c for c in fill if c in lookup.columns and c in movements.columns]
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    apart = lambda takes_part, columns: F.when(takes_part, 0).otherwise(1 + F.pmod(F.xxhash64(*columns), F.lit(4096))).alias("_apart")
    may = F.col(order).isNull() & F.coalesce(F.col("movement_type") == "PI", F.lit(False)) & whole
    asking = movements.select("*", apart(may, movements.columns), F.lit(True).alias("_asks"))
    known = F.col(order).isNotNull() & whole
    telling = lookup.select(*[F.col(k).cast(movements.schema[k].dataType).alias(k) for k in keys], apart(known, [*keys, *fill]), F.when(known, F.struct(*fill)).alias("_told"))
    own = Window.partitionBy("_apart", *keys)
    out = asking.unionByName(telling, allowMissingColumns=True).withColumns({"_least": F.min("_told").over(own), "_most": F.max("_told").over(own)}).where("_asks")
    out = out.withColumn("_found", F.when(F.col("_least").eqNullSafe(F.col("_most")), F.col("_least")))  # of one set of values only, null being a value
    out = out.withColumns({"enriched": F.col("_found").isNotNull().cast("int"), **{c: F.coalesce(c, F.col("_found")[c]) for c in fill}})
    out = out.withColumn("source", F.when(F.col("enriched") == 1, "lookup").when(F.col(order).isNotNull(), "source"))
    return out.select(*movements.columns, "enriched", "source")


def impute_single(df: DataFrame, code: str, date: str) -> DataFrame:
    """Fills a missing date where all known dates of the code agree, with a flag."""
    own = Window.partitionBy(code)
    low, high = F.min(date).over(own), F.max(date).over(own)
    fill = F.when(F.col(date).isNull() & F.col(code).isNotNull() & (low == high), low)
    return df.withColumn("_fill", fill).withColumns({date: F.coalesce(date, "_fill"), "imputed": F.col("_fill").isNotNull().cast("int")}).drop("_fill")


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order, and how many the key had."""
    own = Window.partitionBy(*keys)
    out = df.withColumns({"_k": F.row_number().over(own.orderBy(*order)), "rows": F.count("*").over(own)})
    return out.where("_k = 1").drop("_k")


def match(left: DataFrame, right: DataFrame, on: Sequence[str], flag: str, order: Sequence[Column]) -> DataFrame:
    """Left join to the best row of each key of `right`, with a flag; null keys don't match."""
    whole = right
    for k in on:
        whole = whole.where(F.col(k).isNotNull())
    one = best_row(whole, on, order).drop("rows").withColumn(flag, F.lit(True))
    return left.join(one, list(on), "left").fillna(False, [flag])


def latest_before(rows: DataFrame, keys: Sequence[str], value: str, made: str, target: str, stamp: str) -> DataFrame:
    """As-of: the value made last before its target date, for each key and target."""
    early = rows.where(F.col(made) < F.col(target))
    return early.groupBy(*keys, target).agg(F.max_by(value, F.struct(made, stamp)).alias(value), F.max(made).alias(made))


def open_at(requests: DataFrame, origins: DataFrame, created: str, target: str, by: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Requests open at each origin date (created on or before it, due on or after), and sums of theirs, by target date and more.

    Requests that are open over the same days are added up first; their sums are expanded over
    these days, within the range of origins, and meet the origins by equality; no range join is needed.
    """
    bounds = origins.agg(F.min("origin").alias("low"), F.max("origin").alias("high"))
    added = [F.sum(c).alias(f"open_{c}") for c in sums]
    spans = requests.where(F.col(created) <= F.col(target)).groupBy(created, target, *[c for c in by if c not in (created, target)]).agg(F.count("*").alias("open_requests"), *added)
    start, end = F.greatest(F.col(created), F.col("low")), F.least(F.col(target), F.col("high"))
    days = spans.crossJoin(F.broadcast(bounds)).where(start <= end)  # bounds is one row
    days = days.withColumn("origin", F.explode(F.sequence(start, end))).join(origins.select("origin").distinct(), "origin")
    return days.groupBy("origin", F.col(target).alias("target_date"), *by).agg(F.sum("open_requests").alias("open_requests"), *[F.sum(f"open_{c}").alias(f"open_{c}") for c in sums])


def keys_without(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of `left` that `right` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")


def unique_notes_weekly(notes: DataFrame) -> DataFrame:
    """Distinct notes (code, date, class) by week and class, with week ordinal and total."""
    own = notes.select("service_code", "service_date", "service_class").distinct()
    out = own.groupBy(F.to_date(F.date_trunc("week", "service_date")).alias("week")).pivot("service_class", ["delivery", "pickup", "UNK"]).count().fillna(0)
    total = F.col("delivery") + F.col("pickup") + F.col("UNK")
    return out.withColumns({"total": total, "ordinal": F.row_number().over(Window.orderBy("week"))}).withColumnRenamed("UNK", "unclassified")

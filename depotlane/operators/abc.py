"""ABC classification of items by picking lines, its history, demand patterns and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from depotlane.lineage import cut

#: Percent of lines, counted before the row, below which a row is A, and B.
LIMITS = (80, 95)


def ordered_cumsum(df: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """Adds rank (from 1), cumulative (of `value`, in `order`) and total.

    Rows are dealt to tasks by ranges of the order; each task sums its range, and the ranges'
    offsets, one row for each task, are broadcast. No task holds all rows.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_sum"), F.sum("_s").over(everything).alias("total")
    )
    own = Window.partitionBy("_range").orderBy(*order)
    out = ranged.withColumns({"_rank": F.row_number().over(own), "_own": F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.join(F.broadcast(offsets), "_range")
    out = out.withColumns({"rank": F.col("_rows") + F.col("_rank"), "cumulative": F.col("_sum") + F.col("_own")})
    return out.drop("_range", "_rank", "_own", "_rows", "_sum")


def abc_rank(df: DataFrame, keys: Sequence[str], lines: str = "lines", units: str = "units", partition_by: Sequence[str] = ()) -> DataFrame:
    """Adds rank, percentage, cumulative_percentage and abc_class by the share of lines before the row.

    Rows fall by lines, then units, then keys. Shares are compared in integers. Without
    partition_by all rows are ranked together; with it, each partition by itself. Where no
    lines are counted at all, the class is D.
    """
    order = [F.col(lines).desc(), F.col(units).desc(), *[F.col(k).asc() for k in keys]]
    if partition_by:
        own = Window.partitionBy(*partition_by)
        run = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumns({"rank": F.row_number().over(own.orderBy(*order)).cast("long"), "cumulative": F.sum(lines).over(run), "total": F.sum(lines).over(own)})
    else:
        out = ordered_cumsum(df, order, lines)
    before = (F.col("cumulative") - F.col(lines)) * 100
    grade = F.when(F.col("total") <= 0, "D").when(before < LIMITS[0] * F.col("total"), "A").when(before < LIMITS[1] * F.col("total"), "B").otherwise("C")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0))
    return out.withColumns({"abc_class": grade, "percentage": share(lines), "cumulative_percentage": share("cumulative")}).drop("cumulative", "total")


def classify_abc(movements: DataFrame, stock: DataFrame | None = None) -> DataFrame:
    """One row per picked item: lines, units, last dates, stock, rank, class, coverage and advice."""
    own = movements.withColumns({"movement_type": F.upper("movement_type"), "quantity": F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))}).where("sku is not null and movement_type in ('PI', 'CR')")
    pick, receipt = F.col("movement_type") == "PI", F.col("movement_type") == "CR"
    out = own.groupBy("sku").agg(
        F.min(F.when(pick, F.col("sku_description"))).alias("sku_description"), F.count_if(pick).alias("lines"), F.sum(F.when(pick, F.col("quantity"))).alias("units"),
        F.max(F.when(pick, F.col("operational_date"))).alias("last_pi_date"), F.count_if(receipt).alias("cr_lines"), F.max(F.when(receipt, F.col("operational_date"))).alias("last_cr_date"),
    ).where("lines > 0")
    if stock is None:
        out = out.withColumn("stock_quantity", F.lit(None).cast("double"))
    else:
        out = out.join(stock.groupBy("sku").agg(F.sum("stock_quantity").alias("stock_quantity")), "sku", "left")
    out = abc_rank(out, ["sku"])
    coverage = F.try_divide(F.col("stock_quantity"), F.col("lines"))
    held = F.coalesce(F.col("stock_quantity"), F.lit(0.0))
    advice = (
        F.when(F.col("abc_class") == "A", "keep accessible")
        .when((F.col("abc_class") == "B") & (F.coalesce(coverage, F.lit(0.0)) > 20), "review excess stock")
        .when((F.col("abc_class") == "C") & (held > 0), "review for secondary store")
        .otherwise("keep in main store")
    )
    return out.withColumns({"stock_coverage_lines": coverage, "relocation_advice": advice})


def with_firsts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds new_<column> (1 at one row of each value within the keys, else 0), whose sums are distinct counts.

    Rows are dealt by the keys once and sorted there for each column; distinct aggregates would multiply them before a shuffle.
    """
    out = df.repartition(*keys)
    for c in columns:
        first = F.row_number().over(Window.partitionBy(*keys, c).orderBy(c)) == 1
        out = out.withColumn(f"new_{c}", (first & F.col(c).isNotNull()).cast("int"))
    return out


def aggregate_movements(pi: DataFrame, cr: DataFrame, stock: DataFrame, keys: Sequence[str], reference_date: str) -> DataFrame:
    """Picks, receipts and stock by key set, with recency, coverages and stock density.

    Null keys are a group of their own and match null keys of the other tables. Stock is
    joined on those keys that it has.
    """
    picks = pi.select(*keys, *[c for c in ("sku_description", "quantity", "external_order_id", "location", "operational_date") if c not in keys])
    out = with_firsts(picks, keys, ["external_order_id", "location", "operational_date"]).groupBy(*keys).agg(
        F.min("sku_description").alias("description"), F.count("*").alias("lines"), F.sum("quantity").alias("units"), F.sum("new_external_order_id").alias("orders"),
        F.sum("new_location").alias("locations"), F.min("operational_date").alias("first_pick"), F.max("operational_date").alias("last_pick"), F.sum("new_operational_date").alias("pick_days"),
    )
    receipts = cr.groupBy(*keys).agg(F.count("*").alias("receipt_lines"), F.max("operational_date").alias("last_receipt"))
    shared = [k for k in keys if k in stock.columns]
    held = stock.groupBy(*shared).agg(F.sum("stock_quantity").alias("stock"), F.countDistinct("location").alias("stock_locations"))
    for other, on in ((receipts, list(keys)), (held, shared)):
        other = other.select(*[F.col(k).alias(f"_{k}") for k in on], *[c for c in other.columns if c not in on])
        match = F.lit(True)
        for k in on:
            match &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(other, match, "left").drop(*[f"_{k}" for k in on])
    out = out.fillna(0, ["receipt_lines", "stock", "stock_locations"])
    return with_ratios(out, reference_date)


def with_ratios(df: DataFrame, reference_date: str) -> DataFrame:
    return df.withColumns({
        "days_since_pick": F.datediff(F.lit(reference_date).cast("date"), "last_pick"), "coverage_lines": F.try_divide(F.col("stock"), F.col("lines")),
        "coverage_units": F.try_divide(F.col("stock"), F.col("units")), "stock_density": F.try_divide(F.col("stock"), F.col("stock_locations")),
    })


def article_rollup(owner: DataFrame, reference_date: str) -> DataFrame:
    """Owner and item rows rolled up to items; distinct counts are sums of the owners' counts."""
    sums = ["lines", "units", "orders", "locations", "pick_days", "receipt_lines", "stock", "stock_locations"]
    out = owner.groupBy("sku").agg(
        F.min("description").alias("description"), *[F.sum(c).alias(c) for c in sums], F.min("first_pick").alias("first_pick"), F.max("last_pick").alias("last_pick"), F.max("last_receipt").alias("last_receipt")
    )
    return with_ratios(out, reference_date)


def split(movements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Picks and receipts with an item and a numeric quantity."""
    own = movements.where("sku is not null").withColumns({"movement_type": F.upper("movement_type"), "quantity": F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))})
    return own.where("movement_type = 'PI'"), own.where("movement_type = 'CR'")


def abc_since(movements: DataFrame, stock: DataFrame, reference_date: str, start: str) -> tuple[DataFrame, DataFrame]:
    """ABC by owner and item, and by item, over movements from `start` on."""
    pi, cr = (t.where(F.col("operational_date") >= F.lit(start).cast("date")) for t in split(movements))
    owner = abc_rank(aggregate_movements(pi, cr, stock, ["owner", "sku"], reference_date), ["owner", "sku"])
    article = abc_rank(article_rollup(owner, reference_date), ["sku"])
    return owner, article


def quarter(date: str) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def abc_quarterly(movements: DataFrame, stock: DataFrame, reference_date: str, keys: Sequence[str] = ("sku",), within_quarter: bool = False) -> DataFrame:
    """ABC by quarter and keys; all quarters are ranked together unless within_quarter."""
    pi, cr = (t.withColumn("period", quarter("operational_date")) for t in split(movements))
    out = aggregate_movements(pi, cr, stock, ["period", *keys], reference_date)
    return abc_rank(out, ["period", *keys], partition_by=["period"] if within_quarter else ())


def abc_transitions(quarterly: DataFrame) -> DataFrame:
    """Class changes between an item's successive quarters."""
    own = Window.partitionBy("sku").orderBy("period")
    out = quarterly.withColumns({"previous_class": F.lag("abc_class").over(own), "previous_lines": F.lag("lines").over(own)})
    out = out.where("previous_class is not null")
    return out.select("period", "sku", "previous_class", "abc_class", F.concat("previous_class", F.lit(" -> "), "abc_class").alias("change"), "previous_lines", "lines", (F.col("lines") - F.col("previous_lines")).alias("delta_lines"), "stock")


def activity(pi: DataFrame, period: Column) -> DataFrame:
    """Lines and units of each item by period."""
    return pi.withColumn("period", period).groupBy("sku", "period").agg(F.count("*").alias("lines"), F.sum("quantity").alias("units"))


def temporality(pi: DataFrame, current: DataFrame) -> DataFrame:
    """Spread of an item's monthly lines, its demand pattern and the store decision; `current` has the items' classes."""
    monthly = activity(pi, F.date_format("operational_date", "yyyy-MM"))
    spread = monthly.groupBy("sku").agg(F.count("*").alias("months"), F.avg("lines").alias("mean_lines"), F.stddev_samp("lines").alias("std_lines"), F.max("lines").alias("max_lines"))
    spread = spread.withColumn("cv_lines", F.try_divide(F.coalesce(F.col("std_lines"), F.lit(0.0)), F.col("mean_lines")))
    out = current.select("sku", "abc_class", "lines", "stock", "days_since_pick").join(spread, "sku", "left").fillna(0, ["months"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    pattern = (
        F.when(zero("max_lines") > 4 * zero("mean_lines"), "seasonal").when(zero("cv_lines") > 1.5, "intermittent")
        .when(F.coalesce(F.col("days_since_pick"), F.lit(9999)) > 180, "dormant").when(F.col("months") < 3, "new").otherwise("regular")
    )
    held = zero("stock") > 0
    decision = (
        F.when((F.col("pattern") == "intermittent") & held, "manual review").when(F.col("pattern").isin("dormant", "seasonal") & held, "move off season")
        .when((F.col("abc_class") == "C") & held, "review for secondary store").otherwise("keep accessible")
    )
    out = out.withColumn("pattern", pattern).withColumn("decision", decision)
    return out.withColumns({"may_move": F.col("decision").isin("review for secondary store", "move off season"), "may_keep": F.col("decision") == "keep accessible"})


def decision_counts(decided: DataFrame) -> DataFrame:
    """(section, key, items): items by demand pattern, by decision, and those that may move or stay, in one pass."""
    out = decided.groupingSets([["pattern"], ["decision"], []], "pattern", "decision").agg(F.grouping_id().alias("set"), F.count("*").alias("n"), F.count_if("may_move").alias("may_move"), F.count_if("may_keep").alias("may_keep"))
    row = lambda section, key, n: F.struct(F.lit(section).alias("section"), key.alias("key"), n.alias("items"))
    flags = F.array(*[row("flag", F.lit(c), F.col(c)) for c in ("may_move", "may_keep")])
    rows = F.when(F.col("set") == 1, F.array(row("pattern", F.col("pattern"), F.col("n")))).when(F.col("set") == 2, F.array(row("decision", F.col("decision"), F.col("n")))).otherwise(flags)
    return out.select(F.explode(rows).alias("r")).select("r.*")


def relocation_candidates(classified: DataFrame, n: int = 500) -> DataFrame:
    """The first n items with stock that advice doesn't leave in place, least picked first."""
    out = classified.where("relocation_advice in ('review for secondary store', 'review excess stock')")
    return out.orderBy(F.col("stock_quantity").desc_nulls_last(), F.col("lines").asc(), "sku").limit(n)


def class_summary(frame: DataFrame, name: str) -> DataFrame:
    """Items, lines, units and stock of each class."""
    return frame.groupBy("abc_class").agg(F.countDistinct("sku").alias("items"), F.sum("lines").alias("lines"), F.sum("units").alias("units"), F.sum("stock").alias("stock")).withColumn("dataset", F.lit(name))


def abc_kpis(owner: DataFrame, article: DataFrame, stock: DataFrame) -> DataFrame:
    """One row: items, owner-items, total stock, lines, and items of each class."""
    grades = [F.count_if(F.col("abc_class") == g).alias(f"class_{g.lower()}") for g in "ABCD"]
    items = article.agg(F.count("*").alias("items"), F.sum("lines").alias("lines"), *grades)
    return items.crossJoin(owner.agg(F.count("*").alias("owner_items"))).crossJoin(stock.agg(F.sum("stock_quantity").alias("stock_total")))

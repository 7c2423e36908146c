"""Market baskets: transactions, item pairs, their metrics over time, layout scores.

Tables called items have one row per transaction and item, so rows of an item are its transactions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PAIR = ["article_a", "article_b"]


def transaction_id(order: str = "external_order_id", owner: str = "owner", separator: str = "|", unknown_owner: bool = False) -> Column:
    """Order and owner as one id: null if either is null, or with the owner UNKNOWN where it is."""
    who = F.coalesce(F.col(owner), F.lit("UNKNOWN")) if unknown_owner else F.col(owner)
    return F.concat(F.col(order), F.lit(separator), who)


def basket_lines(movements: DataFrame, *more: str) -> DataFrame:
    """Pick lines with order, owner and item and a positive quantity; more: columns that ride along."""
    own = movements.where("upper(movement_type) = 'PI' and sku is not null and external_order_id is not null and owner is not null and quantity > 0")
    date = F.coalesce("completed_at", "started_at")
    return own.select(transaction_id().alias("transaction_id"), "external_order_id", "owner", F.col("sku").alias("article"), "sku_description", "location", "quantity", date.alias("completion_date"), *more)


def transaction_items(lines: DataFrame, *more: str) -> DataFrame:
    """One row per transaction and item; first values are the least ones. more: columns that a transaction has one value of."""
    return lines.groupBy(*more, "transaction_id", "external_order_id", "owner", "article").agg(
        F.sum("quantity").alias("quantity_sum"), F.count("*").alias("line_count"), F.min("sku_description").alias("article_description"), F.min("location").alias("primary_location"),
        F.countDistinct("location").alias("unique_locations"), F.min("completion_date").alias("first_completion_date"), F.max("completion_date").alias("last_completion_date"),
    )


def transactions(lines: DataFrame, date_strategy: str = "max") -> DataFrame:
    """One row per transaction, dated by its last, first or modal (latest of the most frequent) day."""
    items = transaction_items(lines)
    out = items.groupBy("transaction_id", "external_order_id", "owner").agg(
        F.count("*").alias("basket_size"), F.sum("quantity_sum").alias("total_quantity"), F.count_if(F.col("line_count") > 1).alias("repeated_lines"),
        F.min("first_completion_date").alias("transaction_start"), F.max("last_completion_date").alias("transaction_end"),
    )
    places = lines.groupBy("transaction_id").agg(F.countDistinct(F.coalesce("location", F.lit("[missing]"))).alias("locations"))
    if date_strategy == "mode":
        days = lines.where("completion_date is not null").groupBy("transaction_id", F.to_date("completion_date").alias("day")).agg(F.count("*").alias("n"), F.max("completion_date").alias("last"))
        dated = days.groupBy("transaction_id").agg(F.max_by("last", F.struct("n", "day")).alias("transaction_date"))
    else:
        dated = lines.groupBy("transaction_id").agg((F.min if date_strategy == "min" else F.max)("completion_date").alias("transaction_date"))
    out = out.join(places, "transaction_id").join(dated, "transaction_id", "left")
    return out.withColumns({"repeated_flag": F.col("repeated_lines") > 0, "dispersion": F.try_divide(F.col("locations"), F.col("basket_size")), **_calendar()})


def _calendar() -> dict[str, Column]:
    """Year, quarter and month of a transaction."""
    year, quarter = (part("transaction_date").cast("string") for part in (F.year, F.quarter))
    return {"year": F.year("transaction_date"), "quarter": F.concat(year, F.lit("Q"), quarter), "month": F.date_format("transaction_date", "yyyy-MM")}


def whole_baskets(items: DataFrame, *more: str) -> DataFrame:
    """One row per transaction with what pairs need of its items; a number takes the place of its id, so the rows must be stored before use.

    more: columns that a transaction has one value of, by which the rows may be dealt already. What is counted by
    transaction needs no shuffle here, and the number is shorter than the id where item rows are shuffled.
    """
    out = items.groupBy(*more, "transaction_id").agg(F.collect_list(F.struct("article", "quantity_sum", "last_completion_date")).alias("items"))
    return out.select(F.monotonically_increasing_id().alias("transaction_id"), "items")


def basket_rows(baskets: DataFrame) -> DataFrame:
    """One row per transaction and item of `whole_baskets`."""
    return baskets.where("transaction_id is not null").select("transaction_id", F.inline("items"))  # none is, but joins ask: so all readers ask the same


def basket_figures(baskets: DataFrame) -> DataFrame:
    """What `describe` needs of the transactions, dated by their last day, out of `whole_baskets`: no shuffle."""
    total = F.aggregate("items.quantity_sum", F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    out = baskets.select("transaction_id", F.size("items").cast("long").alias("basket_size"), total.alias("total_quantity"), F.array_max("items.last_completion_date").alias("transaction_date"))
    return out.withColumns(_calendar())


def item_sets(items: DataFrame) -> DataFrame:
    """Sorted item array and item to quantity map of each transaction."""
    return items.groupBy("transaction_id").agg(F.array_sort(F.collect_set("article")).alias("items"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("article", "quantity_sum")))).alias("quantities"))


def sku_locations(lines: DataFrame) -> DataFrame:
    """Observations of an item at each location, their share, and the primary location."""
    own = Window.partitionBy("article")
    out = lines.where("location is not null").groupBy("article", "location").agg(F.count("*").alias("observations"), F.max("completion_date").alias("last_seen"))
    rank = F.row_number().over(own.orderBy(F.col("observations").desc(), F.col("last_seen").desc_nulls_last(), "location"))
    return out.withColumns({"share": F.col("observations") / F.sum("observations").over(own), "primary": rank == 1})


def sku_attributes(lines: DataFrame) -> DataFrame:
    """Modal description, numbers of descriptions and locations, primary and latest location of each item."""
    words = lines.where("sku_description is not null").groupBy("article", "sku_description").count()
    modal = words.groupBy("article").agg(F.min_by("sku_description", F.struct(-F.col("count"), F.col("sku_description"))).alias("description"), F.count("*").alias("descriptions"))
    places = sku_locations(lines).groupBy("article").agg(
        F.count("*").alias("locations"), F.max("share").alias("dominant_share"), F.max(F.when(F.col("primary"), F.col("location"))).alias("primary_location"),
        F.min_by("location", F.struct(-F.unix_timestamp("last_seen"), F.col("location"))).alias("latest_location"),
    )
    out = lines.select("article").distinct().join(modal, "article", "left").join(places, "article", "left").fillna(0, ["descriptions", "locations"])
    return out.withColumn("multi_location", F.col("locations") > 1)


def pair_rows(items: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Pairs of different items of one transaction, a before b, with the lesser quantity.

    Both sides are dealt by the transaction, once; a basket of n items gives n * (n - 1) / 2
    rows, which the aggregation that follows combines before its shuffle.
    """
    cols = ["article", "quantity_sum", *extra]
    side = lambda s: items.select("transaction_id", *[F.col(c).alias(f"{c}_{s}") for c in cols])
    out = side("a").join(side("b"), "transaction_id").where("article_a < article_b")
    return out.withColumn("shared_quantity", F.least("quantity_sum_a", "quantity_sum_b"))


def pair_counts(items: DataFrame) -> DataFrame:
    """Transactions and quantity that each pair of items shares."""
    return pair_rows(items).groupBy(*PAIR).agg(F.count("*").alias("shared_transactions"), F.sum("shared_quantity").alias("shared_quantity"))


def item_metrics(items: DataFrame, support_cap: float | None = None) -> DataFrame:
    """Frequency, support and quantity of each item, and whether rules leave it out as too frequent."""
    total = items.agg(F.countDistinct("transaction_id").alias("total"))
    out = items.groupBy("article").agg(F.count("transaction_id").alias("transaction_frequency"), F.count("*").alias("row_frequency"), F.sum("quantity_sum").alias("total_quantity"), F.avg("quantity_sum").alias("mean_quantity"))
    out = out.crossJoin(F.broadcast(total)).withColumn("support", F.try_divide(F.col("transaction_frequency"), F.col("total"))).drop("total")
    return out.withColumn("too_frequent", F.col("support") > support_cap if support_cap is not None else F.lit(False))


def min_pair_transactions(counts: DataFrame, n_transactions: DataFrame, floor: float = 0.0002, quantile: float = 0.95, least: int = 3, most: int = 5) -> DataFrame:
    """One row, the adaptive threshold: the largest of least, ceil(n * floor) and the quantile of pair counts within [least, most].

    n_transactions has one row and column. The exact quantile comes from the histogram of counts.
    """
    histogram = counts.groupBy("shared_transactions").agg(F.count("*").alias("n"))
    q = histogram.agg(F.expr(f"percentile(shared_transactions, {quantile}, n)").alias("q"))
    out = q.crossJoin(n_transactions.toDF("total"))
    clipped = F.floor(F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), F.coalesce("q", F.lit(float(least))))))
    return out.select(F.greatest(F.lit(least), F.ceil(F.col("total") * floor), clipped).cast("long").alias("min_pair_transactions"))


def with_metrics(pairs: DataFrame, alpha: float = 2.0) -> DataFrame:
    """Pair metrics from shared_transactions, shared_quantity, n_a, n_b, q_a, q_b and total.

    Divisions by zero give 0; conviction is infinite at confidence 1; alpha weighs the penalty
    of popular items.
    """
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    out = pairs.withColumns({"support_a": zero(c("n_a"), c("total")), "support_b": zero(c("n_b"), c("total")), "joint_support": zero(c("shared_transactions"), c("total")), "confidence_a_b": zero(c("shared_transactions"), c("n_a")), "confidence_b_a": zero(c("shared_transactions"), c("n_b"))})
    out = out.withColumn("expected_support", c("support_a") * c("support_b"))
    conviction = lambda confidence, support: F.when(c(confidence) >= 1, F.lit(float("inf"))).otherwise(zero(1 - c(support), 1 - c(confidence)))
    both = (c("confidence_a_b") > 0) & (c("confidence_b_a") > 0)
    pmi = F.when((c("joint_support") > 0) & (c("expected_support") > 0), F.ln(c("joint_support") / c("expected_support"))).otherwise(0.0)
    out = out.withColumns({
        "lift": zero(c("joint_support"), c("expected_support")), "leverage": c("joint_support") - c("expected_support"), "conviction_a_b": conviction("confidence_a_b", "support_b"), "conviction_b_a": conviction("confidence_b_a", "support_a"),
        "balanced_confidence": F.when(both, 2 / (1 / c("confidence_a_b") + 1 / c("confidence_b_a"))).otherwise(F.greatest("confidence_a_b", "confidence_b_a")),
        "jaccard": zero(c("shared_transactions"), c("n_a") + c("n_b") - c("shared_transactions")), "cosine": zero(c("shared_transactions"), F.sqrt(c("n_a") * c("n_b"))),
        "weighted_cosine": zero(c("shared_quantity"), F.sqrt(c("q_a") * c("q_b"))), "pmi": pmi, "max_item_support": F.greatest("support_a", "support_b"),
    })
    npmi = F.when((c("joint_support") > 0) & (c("joint_support") != 1), c("pmi") / -F.ln("joint_support")).otherwise(0.0)
    return out.withColumns({"npmi": npmi, "popularity_factor": 1 / (1 + alpha * c("max_item_support"))}).drop("n_a", "n_b", "q_a", "q_b", "total")


def pair_metrics(items: DataFrame, at_least: int | None = None, alpha: float = 2.0) -> DataFrame:
    """Metrics of the pairs that share at least so many transactions (adaptive by default)."""
    counts = pair_counts(items)
    total = items.agg(F.countDistinct("transaction_id").alias("total"))
    if at_least is None:
        limit = min_pair_transactions(counts, total)
        counts = counts.crossJoin(F.broadcast(limit)).where("shared_transactions >= min_pair_transactions").drop("min_pair_transactions")
    else:
        counts = counts.where(F.col("shared_transactions") >= at_least)
    each = items.groupBy("article").agg(F.count("transaction_id").alias("n"), F.sum("quantity_sum").alias("q"))
    out = counts.join(each.toDF("article_a", "n_a", "q_a"), "article_a").join(each.toDF("article_b", "n_b", "q_b"), "article_b").crossJoin(F.broadcast(total))
    return with_metrics(out, alpha)


def rules(pairs: DataFrame, min_confidence: float = 0.05, min_lift: float = 1.05, support_cap: float | None = None, limit: int = 20_000) -> DataFrame:
    """Directed rules of both directions of each pair, the best `limit` by lift, confidence and count."""
    way = lambda a, b: F.struct(F.col(f"article_{a}").alias("antecedent"), F.col(f"article_{b}").alias("consequent"), F.col(f"support_{a}").alias("antecedent_support"), F.col(f"support_{b}").alias("consequent_support"), F.col(f"confidence_{a}_{b}").alias("confidence"), F.col(f"conviction_{a}_{b}").alias("conviction"))
    out = pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("r"), F.col("joint_support").alias("support"), "lift", "leverage", "npmi", "shared_transactions").select("r.*", "support", "lift", "leverage", "npmi", "shared_transactions")
    out = out.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    if support_cap is not None:
        out = out.where(F.greatest("antecedent_support", "consequent_support") <= support_cap)
    return out.orderBy(F.col("lift").desc(), F.col("confidence").desc(), F.col("shared_transactions").desc(), "antecedent", "consequent").limit(limit)


#: Periods are numbered while rows are counted: 0 is the full history, then the last days (longest first), ten times the year, ten times the year plus the quarter.
WINDOWS = (365, 180, 90)


def _starts(last: Column, windows: Sequence[int]) -> list[Column]:
    """Where each of the windows of days before `last` starts, as columns."""
    return [(last - F.expr(f"interval {d} days")).alias(f"_start_{k}") for k, d in enumerate(windows)]


def _placed(day: Column, windows: Sequence[int]) -> dict[str, Column]:
    """The quarter of a date as a number (0 without a date), and in how many of the windows of `_starts` it falls."""
    recent = sum((F.coalesce((day >= F.col(f"_start_{k}")).cast("int"), F.lit(0)) for k in range(len(windows))), F.lit(0))
    return {"quarter": F.coalesce(F.year(day) * 10 + F.quarter(day), F.lit(0)).cast("int"), "recent": recent.cast("int")}


def dated(items: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Adds the quarter as a number (0 without a date) and in how many of the windows of last days the date falls."""
    starts = items.agg(F.max("last_completion_date").alias("_last")).select(*_starts(F.col("_last"), windows))
    out = items.crossJoin(F.broadcast(starts))  # one row
    return out.withColumns(_placed(F.col("last_completion_date"), windows)).drop(*starts.columns)


def _year(quarter: Column) -> Column:
    """The number of a quarter's year."""
    return quarter - quarter % 10


def _numbers(quarter: Column, recent: Column, windows: Sequence[int]) -> Column:
    """The periods that a row lies in: each one's number as `period`, and its place among the kinds of periods; null for kinds it doesn't lie in.

    A quarter of a year that ends in 0 stands for the year alone.
    """
    kind = lambda k, number, here: F.when(here, F.struct(number.cast("int").alias("period"), F.lit(k).alias("kind")))
    spans = [kind(k + 2, F.lit(k), recent >= k) for k in range(1, len(windows) + 1)]
    return F.array(kind(0, F.lit(0), F.lit(True)), kind(1, _year(quarter), quarter > 0), kind(2, quarter, quarter % 10 > 0), *spans)


def _exploded(rows: DataFrame, windows: Sequence[int]) -> DataFrame:
    out = rows.withColumn("_p", F.explode(_numbers(F.col("quarter"), F.col("recent"), windows))).where("_p is not null")
    return out.withColumns({"period": F.col("_p.period"), "kind": F.col("_p.kind")}).drop("_p", "quarter", "recent")


def period_totals(marked: DataFrame, windows: Sequence[int] = WINDOWS, least_transactions: int = 2) -> DataFrame:
    """period (its number), label, total and whether any pair lies in it, of each period with enough transactions (some rows).

    marked: of `dated`. Whether a transaction has different items is told by hashes of 64 bits.
    """
    item = F.xxhash64("article")
    own = marked.select("transaction_id", *_DATES, item.alias("item")).where("transaction_id is not null")
    each = _exploded(own.repartition("transaction_id"), windows)  # dealt before rows multiply
    each = each.groupBy("transaction_id", "period").agg(F.min("item").alias("low"), F.max("item").alias("high"))
    return _labelled(each.select("period", (F.col("low") != F.col("high")).alias("paired")), windows, least_transactions)


def basket_totals(baskets: DataFrame, windows: Sequence[int] = WINDOWS, least_transactions: int = 2) -> DataFrame:
    """As `period_totals`, of `whole_baskets`: periods are told apart within each row, so no rows are shuffled by transaction."""
    starts = baskets.agg(F.max(F.array_max("items.last_completion_date")).alias("_last")).select(*_starts(F.col("_last"), windows))
    place = lambda item: F.struct(item["article"].alias("article"), *[c.alias(n) for n, c in _placed(item["last_completion_date"], windows).items()])
    numbers = lambda x: F.array_compact(F.array(F.lit(0), F.when(x["quarter"] > 0, _year(x["quarter"])), F.when(x["quarter"] > 0, x["quarter"]), *[F.when(x["recent"] >= k, k) for k in range(1, len(windows) + 1)]))
    placed = F.transform("items", place)
    plain = F.flatten(F.transform(placed, numbers))
    named = F.flatten(F.transform(placed, lambda x: F.transform(numbers(x), lambda p: F.struct(p.alias("period"), x["article"].alias("article")))))
    again = F.size("items") != F.size(F.array_distinct("items.article"))  # orders and owners whose ids read the same may share an item
    own = baskets.crossJoin(F.broadcast(starts)).select(F.when(again, F.array_distinct(named)["period"]).otherwise(plain).alias("own"))  # one row
    paired = lambda p: F.size(F.array_remove("own", p)) + 1 < F.size("own")
    each = own.select(F.inline(F.transform(F.array_distinct("own"), lambda p: F.struct(p.alias("period"), paired(p).alias("paired")))))
    return _labelled(each, windows, least_transactions)


def _labelled(each: DataFrame, windows: Sequence[int], least_transactions: int) -> DataFrame:
    """period, label, total and whether any is paired, from one row for each period of a transaction."""
    out = each.groupBy("period").agg(F.count("*").alias("total"), F.max("paired").alias("paired")).where(F.col("total") >= least_transactions)
    n, year = F.col("period"), F.floor(F.col("period") / 10).cast("string")
    names = ["full_history", *[f"last_{d}_days" for d in sorted(windows, reverse=True)]]
    label = F.when(n < len(names), F.get(F.array(*map(F.lit, names)), n)).when(n % 10 == 0, F.concat(F.lit("year_"), year)).otherwise(F.concat(F.lit("quarter_"), year, F.lit("Q"), (n % 10).cast("string")))
    return out.withColumn("label", label)


def _counted(marked: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Items with `n` and `q`, their transactions and quantity in each kind of period, as far as the row may lie in it.

    Rows are dealt by item once and sorted once, by item, year and quarter.
    """
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    item = Window.partitionBy("article").orderBy("year", "quarter").rowsBetween(*whole)
    year = Window.partitionBy("article", "year").orderBy("quarter").rowsBetween(*whole)
    quarter = Window.partitionBy("article", "year", "quarter")
    tally = {"n": lambda here: F.count(F.when(here, F.col("transaction_id"))), "q": lambda here: F.sum(F.when(here, F.col("quantity_sum")))}
    spans = lambda f: [*[f(F.lit(True)).over(w) for w in (item, year, quarter)], *[f(F.col("recent") >= k).over(item) for k in range(1, len(windows) + 1)]]
    out = marked.repartition("article").withColumn("year", _year(F.col("quarter")))
    return out.withColumns({c: F.slice(F.array(*spans(f)), 1, F.col("recent") + 3) for c, f in tally.items()}).drop("year")


def _common() -> dict[str, Column]:
    """Quarter (or year alone) and last days that both rows of a pair fall in."""
    a, b = F.col("quarter_a"), F.col("quarter_b")
    return {"quarter": F.when(a == b, a).when(_year(a) == _year(b), _year(a)).otherwise(0), "recent": F.least("recent_a", "recent_b")}


_DATES = ["quarter", "recent"]


def temporal_pairs(items: DataFrame, least_transactions: int = 2, at_least: int = 1, windows: Sequence[int] = WINDOWS, totals: DataFrame | None = None, by_pair: bool = False) -> DataFrame:
    """Pair metrics in every period with enough transactions, of pairs that share at least so many over the full history.

    The items of a transaction are paired once; a pair then counts in the periods that both
    item rows fall in. Rows of an item carry its own counts, so the pairs aren't joined with them. Where few pairs
    share `at_least` transactions, the others go before anything is counted by period, and the rest is joined.
    totals: of `period_totals` or `basket_totals`, if it is there already; other columns of it ride along. by_pair: deals what pairs share by pair before it is
    counted, not by pair and period after it, so that what follows by pair needs no shuffle.
    """
    marked = dated(items, windows)
    totals = period_totals(marked, windows, least_transactions) if totals is None else totals
    if at_least > 1:
        pairs = pair_rows(marked, _DATES).withColumns(_common()).groupBy(*PAIR, *_DATES).agg(F.count("*").alias("n"), F.sum("shared_quantity").alias("q"))
        pairs = pairs.withColumn("_all", F.sum("n").over(Window.partitionBy(*PAIR))).where(F.col("_all") >= at_least).drop("_all")
        counts = _exploded(pairs, windows).groupBy("period", *PAIR).agg(F.sum("n").alias("shared_transactions"), F.sum("q").alias("shared_quantity"))
        single = _exploded(marked, windows).groupBy("period", "article").agg(F.count("transaction_id").alias("n"), F.sum("quantity_sum").alias("q"))
        for side in "ab":
            counts = counts.join(single.toDF("period", f"article_{side}", f"n_{side}", f"q_{side}"), ["period", f"article_{side}"])
    else:
        own = [f"{c}_{side}" for side in "ab" for c in "nq"]
        pairs = _exploded(pair_rows(_counted(marked, windows), [*_DATES, "n", "q"]).withColumns(_common()), windows)
        pairs = pairs.select("period", *PAIR, "shared_quantity", *[F.get(c, F.col("kind")).alias(c) for c in own])
        pairs = pairs.repartition(*PAIR) if by_pair else pairs
        counts = pairs.groupBy("period", *PAIR).agg(F.count("*").alias("shared_transactions"), F.sum("shared_quantity").alias("shared_quantity"), *[F.min(c).alias(c) for c in own])  # the same in all rows
    out = counts.join(F.broadcast(totals.drop("paired")), "period").withColumn("period", F.col("label")).drop("label")  # one row for each period
    return with_metrics(out.withColumn("period_transactions", F.col("total")))


def pairs_of_history(temporal: DataFrame, at_least: int) -> DataFrame:
    """Metrics over the full history out of those by period, of pairs that share at least so many transactions."""
    return temporal.where((F.col("period") == "full_history") & (F.col("shared_transactions") >= at_least)).drop("period", "period_transactions")


def _steadiness(column: str) -> Column:
    """1 / (1 + coefficient of variation), 0 where the mean is 0."""
    mean = F.avg(column)
    return F.when(mean != 0, 1 / (1 + F.stddev_pop(column) / mean)).otherwise(0.0)


def _trend(slope: Column, mean: Column) -> Column:
    tolerance = F.greatest(F.abs(mean) * 0.05, F.lit(1e-6))
    return F.when(slope > tolerance, "growing").when(slope < -tolerance, "declining").otherwise("stable")


def stability(temporal: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """Presence, spread, trend and stability score of each pair over its periods.

    Trends follow the periods but the full history, ordered by start and then as listed:
    last days before years before quarters. available: one row, the number of periods that have any pair, where
    `temporal` has some of the pairs only. Pairs are dealt once, for their order and for all sums.
    """
    if available is None:
        available = temporal.agg(F.countDistinct("period").alias("available"))
    part = F.col("period") != "full_history"
    kind = F.when(F.col("period").startswith("last_"), 1).when(F.col("period").startswith("year_"), 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy(*PAIR).orderBy((~part).cast("int"), "period_start", kind, "period"))
    placed = temporal.withColumn("x", place.cast("double"))
    slope = lambda c: F.when(F.count_if(part) > 0, F.coalesce(F.regr_slope(F.when(part, F.col(c)), F.col("x")), F.lit(0.0)))
    mean = lambda c: F.avg(F.when(part, F.col(c)))
    out = placed.groupBy(*PAIR).agg(
        F.count("period").alias("periods_present"), F.avg("joint_support").alias("support_mean"), F.stddev_samp("joint_support").alias("support_std"), F.max("joint_support").alias("support_max"),
        F.avg("lift").alias("lift_mean"), F.stddev_samp("lift").alias("lift_std"), _steadiness("joint_support").alias("support_stability"), _steadiness("lift").alias("lift_stability"),
        slope("joint_support").alias("support_slope"), slope("lift").alias("lift_slope"), mean("joint_support").alias("s"), mean("lift").alias("l"),
    )
    trend = lambda c, m: F.when(F.col(c).isNotNull(), _trend(F.col(c), F.col(m)))
    out = out.withColumns({"support_trend": trend("support_slope", "s"), "lift_trend": trend("lift_slope", "l")}).drop("s", "l")
    out = out.withColumn("trend", F.when(F.col("support_trend").isNotNull(), F.when(F.col("support_trend") == F.col("lift_trend"), F.col("support_trend")).otherwise("stable")))
    out = out.crossJoin(F.broadcast(available)).withColumn("presence_ratio", F.col("periods_present") / F.col("available"))
    steady = F.when(F.coalesce("support_trend", F.lit("stable")) != "declining", 1.0).otherwise(0.0)
    return out.withColumn("stability_score", 0.40 * F.col("presence_ratio") + 0.25 * F.col("support_stability") + 0.20 * F.col("lift_stability") + 0.15 * steady)


def with_period_start(periods: DataFrame, last: str, label: str = "period") -> DataFrame:
    """Adds the first day of each period; `last` is the date of the last item row, `label` the column with the period's name."""
    number = lambda pattern: F.regexp_extract(label, pattern, 1).try_cast("int")
    year, first_month = number("_([0-9]{4})"), number("Q([1-4])") * 3 - 2
    p = F.col(label)
    start = (
        F.when(p.startswith("last_"), F.date_sub(F.lit(last).cast("date"), number("^last_([0-9]+)_days")))
        .when(p.startswith("year_"), F.make_date(year, F.lit(1), F.lit(1)))
        .when(p.startswith("quarter_"), F.make_date(year, first_month, F.lit(1)))
    )
    return periods.withColumn("period_start", start)


#: Weights of the layout score.
WEIGHTS = {"joint_frequency": 0.30, "lift": 0.12, "balanced_confidence": 0.14, "similarity": 0.12, "temporal_stability": 0.20, "weighted_volume": 0.12}
BINS, LABELS = (0.25, 0.45, 0.65), ("low", "medium", "high", "very_high")


def layout_scores(pairs: DataFrame, steady: DataFrame, weights: dict[str, float] = WEIGHTS, recurrence_floor: float = 0.25) -> DataFrame:
    """Scaled components, penalties, layout score, its label and hints for the placing of each pair."""
    c, lit = F.col, F.lit
    zero = lambda x: F.coalesce(x, lit(0.0))
    out = pairs.join(steady.select(*PAIR, "stability_score", "presence_ratio"), PAIR, "left").fillna(0.0, ["stability_score", "presence_ratio"])
    out = out.withColumn("log_lift", F.log1p(F.greatest(c("lift") - 1, lit(0.0))))
    scales = out.agg(
        F.max("shared_transactions").alias("max_n"), F.max("shared_quantity").alias("max_q"), F.expr("percentile(log_lift, 0.9)").alias("cap_l"), F.max("log_lift").alias("max_l"),
        F.expr("percentile(balanced_confidence, 0.95)").alias("cap_c"), F.max("balanced_confidence").alias("max_c"), F.expr("percentile(shared_transactions, 0.99)").alias("p99"), F.min("shared_transactions").alias("min_n"), F.expr("percentile(shared_transactions, 0.5)").alias("median_n"),
    )
    out = out.crossJoin(F.broadcast(scales))
    logged = lambda x, top: F.when(c(top) > 0, F.log1p(c(x).cast("double")) / F.log1p(c(top).cast("double"))).otherwise(0.0)

    def capped(x: str, cap: str, top: str) -> Column:
        limit = F.when(c(cap) > 0, c(cap)).otherwise(F.greatest(c(cap), c(top), lit(1e-9)))
        return F.least(F.greatest(c(x), lit(0.0)), limit) / limit

    unit = lambda x: F.least(F.greatest(x, lit(0.0)), lit(1.0))
    out = out.withColumns({
        "joint_frequency_component": logged("shared_transactions", "max_n"), "lift_component": capped("log_lift", "cap_l", "max_l"), "balanced_confidence_component": capped("balanced_confidence", "cap_c", "max_c"),
        "similarity_component": (zero(c("jaccard")) + zero(c("cosine")) + F.least(zero(c("weighted_cosine")), lit(1.0)) + unit(zero(c("npmi")))) / 4,
        "weighted_volume_component": logged("shared_quantity", "max_q"), "temporal_stability_component": unit(c("stability_score")),
    })
    weighted = sum((lit(w) * c(f"{n}_component") for n, w in weights.items()), lit(0.0))
    floor = F.greatest(F.floor("p99"), c("min_n"), lit(1))
    recurrence = F.least(F.greatest(c("shared_transactions") / floor, lit(recurrence_floor)), lit(1.0))
    out = out.withColumns({"weighted_score": weighted, "relevance_factor": recurrence * (0.4 + 0.6 * unit(c("presence_ratio")))})
    out = out.withColumn("layout_score", unit(c("weighted_score") * c("relevance_factor") * F.least(F.greatest(c("popularity_factor"), lit(0.1)), lit(1.0))))
    label = F.when(c("layout_score") <= BINS[0], LABELS[0]).when(c("layout_score") <= BINS[1], LABELS[1]).when(c("layout_score") <= BINS[2], LABELS[2]).otherwise(LABELS[3])
    out = out.withColumns({"proximity": label, "same_slot_area": (c("layout_score") >= BINS[2]) & (c("shared_transactions") >= c("median_n")) & (c("stability_score") >= 0.55)})
    out = out.withColumns({
        "same_zone": (c("layout_score") >= BINS[1]) & ~c("same_slot_area"),
        "manual_review": ((c("lift_component") >= 0.70) & (c("joint_frequency_component") < 0.35)) | ((c("layout_score") >= BINS[1]) & (c("presence_ratio") < 0.40)),
    })
    hint = F.when(c("same_slot_area"), "place side by side").when(c("same_zone"), "keep in one zone").when(c("manual_review"), "review by hand").otherwise("monitor")
    return out.withColumn("hint", hint).drop("log_lift", *scales.columns)


def graph_edges(scored: DataFrame, min_score: float = 0.18, min_shared: int = 3, limit: int | None = None) -> DataFrame:
    """Strong pairs as edges of an item graph: all of them, or the strongest `limit`."""
    out = scored.where((F.col("layout_score") >= min_score) & (F.col("shared_transactions") >= min_shared))
    if limit is not None:
        order = [F.col(x).desc() for x in ("layout_score", "shared_transactions", "stability_score", "lift")]
        out = out.orderBy(*order, *PAIR).limit(limit)
    return out.select(*PAIR, F.col("layout_score").alias("weight"), "lift", "shared_transactions")


def similarity_matrix(scored: DataFrame, items: DataFrame, n: int = 20) -> DataFrame:
    """Scores between the n most frequent items, both ways, 1 on the diagonal and 0 where unpaired: one row per cell."""
    top = items.orderBy(F.col("transaction_frequency").desc(), "article").limit(n).select("article")
    cells = top.toDF("row").crossJoin(F.broadcast(top.toDF("column")))  # n * n cells
    known = scored.select(F.explode(F.array(F.struct(F.col("article_a").alias("row"), F.col("article_b").alias("column")), F.struct(F.col("article_b").alias("row"), F.col("article_a").alias("column")))).alias("p"), "layout_score").select("p.*", "layout_score")
    out = cells.join(known, ["row", "column"], "left")
    return out.select("row", "column", F.when(F.col("row") == F.col("column"), 1.0).otherwise(F.coalesce("layout_score", F.lit(0.0))).alias("score"))


def describe(txs: DataFrame) -> DataFrame:
    """Long table (section, key, metric, value): overall figures, per year, quarter and month, and by basket size.

    All sections come from one pass; a null key is a period of transactions without a date.
    """
    sections = {"overall": None, "year": "year", "quarter": "quarter", "month": "month", "basket_size": "size"}
    keys = [c for c in sections.values() if c]
    own = txs.select(F.col("basket_size").alias("size"), "year", "quarter", "month", "basket_size", "total_quantity")
    out = own.groupingSets([[c] if c else [] for c in sections.values()], *keys).agg(
        F.grouping_id().alias("set"), F.count("*").alias("transactions"), F.avg("basket_size").alias("mean_basket"), F.percentile("basket_size", F.lit(0.5)).alias("median_basket"), F.sum("total_quantity").alias("quantity")
    )
    section, key = F.lit("overall"), F.lit("all")
    for name, column in sections.items():
        if column:  # a set's number has a bit for each key that is not in it, the last key's bit being 1
            here = F.col("set") == sum(2**k for k, c in enumerate(reversed(keys)) if c != column)
            section, key = F.when(here, name).otherwise(section), F.when(here, F.col(column).cast("string")).otherwise(key)
    values = ["transactions", "mean_basket", "median_basket", "quantity"]
    return out.select(section.alias("section"), key.alias("key"), *[F.col(v).cast("double").alias(v) for v in values]).unpivot(["section", "key"], values, "metric", "value")


def owner_items(items: DataFrame) -> DataFrame:
    """Per owner and item: transactions, quantity, lines, first and last date."""
    return items.groupBy("owner", "article").agg(
        F.countDistinct("transaction_id").alias("transaction_frequency"), F.count("*").alias("row_frequency"), F.sum("quantity_sum").alias("total_quantity"), F.min("last_completion_date").alias("first_seen"), F.max("last_completion_date").alias("last_seen")
    )


def item_summary(per_owner: DataFrame) -> DataFrame:
    """Per item, from its rows by owner: transactions (each has one owner), rows, quantity and its mean, owners, first and last date."""
    out = per_owner.groupBy("article").agg(
        *[F.sum(c).alias(c) for c in ("transaction_frequency", "row_frequency", "total_quantity")], F.count("owner").alias("owner_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    return out.withColumn("mean_quantity", F.col("total_quantity") / F.col("row_frequency"))


def unified_series(described: DataFrame, temporal: DataFrame) -> DataFrame:
    """One long table of both kinds of series: figures of all transactions by period, and of each pair by period.

    described: section, key, metric, value, as from `describe`. Pair columns are null in the former.
    """
    whole = described.where("section in ('year', 'quarter', 'month')").select(F.lit("aggregate_transactions").alias("series_type"), F.col("section").alias("granularity"), F.col("key").alias("period"), "metric", "value")
    grain = F.when(F.col("period") == "full_history", "full_history").otherwise(F.substring_index("period", "_", 1))
    figures = ["shared_transactions", "joint_support", "lift", "jaccard", "npmi"]
    pairs = temporal.select(F.lit("pair_affinity").alias("series_type"), grain.alias("granularity"), "period", *PAIR, *[F.col(c).cast("double").alias(c) for c in figures])
    return whole.unionByName(pairs.unpivot(["series_type", "granularity", "period", *PAIR], figures, "metric", "value"), allowMissingColumns=True)


def highlights(scored: DataFrame, steady: DataFrame, n: int = 10) -> DataFrame:
    """Executive lists of pairs: best, strong but rare, emerging; one row per list and rank.

    A pair emerges where its trend, or that of its support or lift alone, grows.
    """
    own = scored.join(steady.select(*PAIR, "trend", "support_trend", "lift_trend"), PAIR, "left")
    grows = (F.col("trend") == "growing") | (F.col("support_trend") == "growing") | (F.col("lift_trend") == "growing")
    lists = {
        "best": (own, [F.col("layout_score").desc(), F.col("shared_transactions").desc()]),
        "strong_but_rare": (own, [F.col("lift").desc(), F.col("shared_transactions")]),
        "emerging": (own.where(grows), [F.col("layout_score").desc(), F.col("shared_transactions").desc()]),
    }
    out = None
    for name, (frame, order) in lists.items():
        top = frame.orderBy(*order, *PAIR).limit(n).select(F.lit(name).alias("list"), *PAIR, "layout_score", "lift", "shared_transactions")
        out = top if out is None else out.unionByName(top)
    return out

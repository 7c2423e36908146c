"""Profiling and quality checks of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, nulls, rows and null_pct of each column, in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    out = counts.unpivot(["rows"], columns, "column", "nulls")
    return out.select("column", "nulls", "rows", F.coalesce(F.try_divide(F.col("nulls"), F.col("rows")), F.lit(0.0)).alias("null_pct"))


def issues(df: DataFrame, keys: Sequence[str], quantity: str, subset: Sequence[str], model: Column) -> DataFrame:
    """Issue table: missing keys, non-positive quantities, rows in groups of duplicates, rows for the model; with shares and severity."""
    groups = df.groupBy(*subset).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(k).isNull()).alias(f"missing_{k}") for k in keys], F.count_if(F.col(quantity) <= 0).alias("non_positive_quantity"), F.count_if(model).alias("model_rows")
    )
    names = [f"missing_{k}" for k in keys] + ["non_positive_quantity", "potential_duplicates", "model_rows"]
    sums = groups.agg(F.sum("n").alias("total"), *[F.sum(f"missing_{k}").alias(f"missing_{k}") for k in keys], F.sum("non_positive_quantity").alias("non_positive_quantity"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("potential_duplicates"), F.sum("model_rows").alias("model_rows"))
    out = sums.unpivot(["total"], names, "issue", "rows")
    share = F.coalesce(F.try_divide(F.col("rows"), F.col("total")), F.lit(0.0))
    severity = F.when(F.col("issue") == "model_rows", "info").when(share > 0.10, "high").when(share > 0.01, "medium").when(share > 0, "low").otherwise("none")
    return out.select("issue", "rows", share.alias("share"), severity.alias("severity"))


def stages(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Rows before any and after each of consecutive filters, with their share of all: one pass."""
    kept, counts = F.lit(True), {"all": F.count("*")}
    for name, condition in conditions.items():
        kept &= F.coalesce(condition, F.lit(False))
        counts[name] = F.count_if(kept)
    out = df.agg(F.count("*").alias("total"), *[c.alias(n) for n, c in counts.items()]).unpivot(["total"], list(counts), "stage", "rows")
    return out.select("stage", "rows", F.coalesce(F.try_divide(F.col("rows"), F.col("total")), F.lit(0.0)).alias("share"))


def movement_qa(df: DataFrame, raw_dates: Mapping[str, Column], quantity: str = "quantity", date: str = "operational_date", order: str = "external_order_id", kind: str = "movement_type", n: int = 20) -> DataFrame:
    """(section, key, value): rows, unreadable dates, missing quantities and dates, picks and those without an order, and the n most frequent types.

    raw_dates: for each name the parsed form of a raw column of that name; a date is unreadable where only the raw one is there.
    """
    pick = F.col(kind) == "PI"
    missing = lambda c: F.avg(F.col(c).isNull().cast("int"))
    failed = {f"unreadable_{name}": F.count_if(F.nullif(F.trim(name), F.lit("")).isNotNull() & parsed.isNull()) for name, parsed in raw_dates.items()}
    figures = {"rows": F.count("*"), **failed, "missing_quantity_pct": missing(quantity), "missing_date_pct": missing(date), "picks": F.count_if(pick), "picks_without_order_pct": F.avg(F.when(pick, F.col(order).isNull().cast("int")))}
    whole = df.agg(*[c.cast("double").alias(k) for k, c in figures.items()]).fillna(1.0, ["picks_without_order_pct"]).unpivot([], list(figures), "key", "value")
    types = top_values(df, kind, n).select(F.lit("type").alias("section"), F.col("value").alias("key"), F.col("count").cast("double").alias("value"))
    return whole.select(F.lit("overall").alias("section"), "key", "value").unionByName(types)


def potential_duplicates(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """All members of groups that agree on the subset."""
    return df.withColumn("group_size", F.count("*").over(Window.partitionBy(*subset))).where("group_size > 1")


def drop_duplicates(df: DataFrame, subset: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One row of each group, and a one-row table with the number removed."""
    removed = df.groupBy(*subset).agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("removed"))
    return df.dropDuplicates(list(subset)), removed


def model_filter(df: DataFrame, keys: Sequence[str], quantity: str = "quantity") -> tuple[DataFrame, DataFrame]:
    """Rows for the model (picks, keys present, quantity positive) and those left out, with the reason."""
    missing = F.lit(False)
    for k in keys:
        missing |= F.col(k).isNull()
    reason = F.when(F.coalesce(F.upper("movement_type"), F.lit("")) != "PI", "not a pick").when(missing, "missing key").when(~F.coalesce(F.col(quantity) > 0, F.lit(False)), "quantity not positive")
    tagged = df.withColumn("excluded_because", reason)
    return tagged.where("excluded_because is null").drop("excluded_because"), tagged.where("excluded_because is not null")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that the table lacks (names only)."""
    return [c for c in required if c not in df.columns]


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most frequent values."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<EMPTY>")).alias("value")).count().orderBy(F.col("count").desc(), "value").limit(n)


def prefix_frequencies(df: DataFrame, code: str, n: int = 50) -> DataFrame:
    """The n most frequent leading letters of a code; codes without any count as OTHER."""
    letters = F.nullif(F.regexp_extract(F.coalesce(F.upper(F.trim(code)), F.lit("")), "^[A-Z]+", 0), F.lit(""))
    return df.groupBy(F.coalesce(letters, F.lit("OTHER")).alias("prefix")).count().orderBy(F.col("count").desc(), "prefix").limit(n)


def classification_qa(df: DataFrame, code: str = "service_code", concept: str = "concept", n: int = 5) -> DataFrame:
    """Per class: rows, share, and up to n example codes, the first by code and concept.

    The filter on the rank lets Spark keep n rows of each class in every task before any are shuffled.
    """
    rank = F.row_number().over(Window.partitionBy("service_class").orderBy(code, concept))
    first = df.select("service_class", code, concept).withColumn("k", rank).where(F.col("k") <= n)
    examples = first.groupBy("service_class").agg(F.array_join(F.array_sort(F.collect_list(code)), ",").alias("examples"))
    out = df.groupBy("service_class").agg(F.count("*").alias("rows")).join(F.broadcast(examples), "service_class", "left")  # a row for each class
    return out.select("service_class", "rows", "examples", (F.col("rows") / F.sum("rows").over(Window.partitionBy())).alias("share"))


def unknown_concepts(df: DataFrame, concept: str = "concept", n: int = 50) -> DataFrame:
    """The n most frequent concepts of rows without a class, with the share of such rows in all."""
    counts = df.groupBy(F.coalesce(F.col(concept), F.lit("<EMPTY>")).alias("concept")).agg(F.count("*").alias("all"), F.count_if(F.col("service_class") == "UNK").alias("rows"))
    share = counts.agg((F.sum("rows") / F.sum("all")).alias("unknown_pct"))
    top = counts.where("rows > 0").orderBy(F.col("rows").desc(), "concept").limit(n)
    return top.select("concept", "rows").crossJoin(F.broadcast(share))  # one row


def date_field_usage(df: DataFrame) -> DataFrame:
    """Use of each date field by service type: rows, share, fallbacks, missing, first and last date."""
    out = df.groupBy("service_type", "field").agg(
        F.count("*").alias("rows"), F.avg(F.col("fallback").cast("int")).alias("fallback_pct"), F.avg(F.col("missing").cast("int")).alias("missing_pct"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    return out.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("service_type")))


def join_coverage(df: DataFrame, flag: str, group: str | None = None) -> DataFrame:
    """Rows, matches and their share, overall and by group; a null group shows as <UNMATCHED>."""
    figures = [F.count("*").alias("rows"), F.count_if(flag).alias("matched"), F.avg(F.col(flag).cast("int")).alias("matched_pct")]
    out = df.groupBy(F.lit("all").alias("scope")).agg(*figures)
    if group:
        out = out.unionByName(df.groupBy(F.coalesce(F.col(group), F.lit("<UNMATCHED>")).alias("scope")).agg(*figures))
    return out


def unmatched_keys(left: DataFrame, right: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Top keys of `left` without a partner."""
    lost = left.where(F.col(key).isNotNull()).join(right.select(key).distinct(), key, "left_anti")
    return lost.groupBy(key).count().orderBy(F.col("count").desc(), key).limit(n)


def unmatched_aligned(left: DataFrame, left_key: str, right: DataFrame, right_key: str, flag: str, n: int = 50) -> DataFrame:
    """value, left, right: the n most frequent keys without a match of two flagged tables, side by side; 0 where one hasn't it."""
    top = lambda df, key, name: df.where(~F.col(flag)).groupBy(F.coalesce(F.col(key).cast("string"), F.lit("<NULL>")).alias("value")).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), "value").limit(n)
    return top(left, left_key, "left").join(top(right, right_key, "right"), "value", "full").fillna(0, ["left", "right"])  # n rows each


def _moves(df: DataFrame, code: str, date: str, version: Column) -> DataFrame:
    """Per code with a date: number of dates, first, last and latest known one, and days from first to latest known.

    The latest known date is that of the newest version, then the latest: both in one number, so that it is found by
    hash aggregation. Dates and versions count from 1900.
    """
    seconds = F.coalesce(F.unix_timestamp(version.cast("timestamp")) - F.unix_timestamp(F.lit("1900-01-01").cast("timestamp")), F.lit(0))
    key = F.when(F.col(date).isNotNull(), seconds * 2**18 + F.datediff(date, F.lit("1900-01-01").cast("date")))
    out = df.groupBy(code).agg(F.countDistinct(date).alias("dates"), F.min(date).alias("first"), F.max(date).alias("last"), F.max_by(date, key).alias("latest")).where("dates > 0")
    return out.withColumn("shift", F.datediff("latest", "first"))


def several_dates(df: DataFrame, code: str, date: str, version: Column) -> DataFrame:
    """Codes with several target dates: how many, how many of these moved, and by how far from first to latest known."""
    per = _moves(df, code, date, version)
    many = F.when(F.col("dates") > 1, F.col("shift"))
    return per.agg(
        F.count("*").alias("codes"), F.count_if(F.col("dates") > 1).alias("with_several"), F.avg((F.col("dates") > 1).cast("int")).alias("share"), F.coalesce(F.avg((many != 0).cast("int")), F.lit(0.0)).alias("moved_share"),
        F.percentile(many, F.lit(0.5)).alias("median_shift"), F.percentile(many, F.lit(0.9)).alias("p90_shift"), F.max(many).alias("max_shift"),
    )


def most_moved(df: DataFrame, code: str, date: str, version: Column, n: int = 20) -> DataFrame:
    """The n codes with several dates that moved farthest."""
    return _moves(df, code, date, version).where("dates > 1").orderBy(F.col("shift").desc(), code).limit(n)


def reference_coverage(compared: DataFrame, kpis: Sequence[str], value: str = "reference") -> DataFrame:
    """Per KPI of a comparison (date, kpi, value): rows, known and missing values, their sum and range; an error without any."""
    wanted = compared.sparkSession.createDataFrame([(k,) for k in kpis], "kpi string")
    own = compared.groupBy("kpi").agg(F.count("*").alias("rows"), F.count(value).alias("known"), F.sum(value).alias("total"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    out = wanted.join(own, "kpi", "left").fillna(0, ["rows", "known"])
    return out.withColumns({
        "missing": F.col("rows") - F.col("known"), "missing_pct": F.coalesce(F.try_divide(F.col("rows") - F.col("known"), F.col("rows")), F.lit(0.0)), "status": F.when(F.col("known") > 0, "ok").otherwise("error"),
    })


def reference_alignment(forecasts: DataFrame, compared: DataFrame, kpis: Sequence[str], value: str = "reference") -> DataFrame:
    """Per KPI and quarter that any of the KPIs is forecast in: rows and sums of forecast and reference, an error without reference."""
    own = forecasts.where(F.col("kpi").isin(*kpis)).groupBy("kpi", F.quarter("date").alias("quarter")).agg(F.count("*").alias("forecast_rows"), F.sum("forecast_value").alias("forecast_sum"))
    other = compared.groupBy("kpi", F.quarter("date").alias("quarter")).agg(F.count("*").alias("reference_rows"), F.count(value).alias("reference_known"), F.sum(value).alias("reference_sum"))
    grid = own.select("quarter").distinct().withColumn("kpi", F.explode(F.array(*map(F.lit, kpis))))  # four quarters at most
    out = grid.join(own, ["kpi", "quarter"], "left").join(other, ["kpi", "quarter"], "left")
    out = out.fillna(0, ["forecast_rows", "reference_rows", "reference_known"]).fillna(0.0, ["forecast_sum", "reference_sum"])
    return out.withColumn("status", F.when(F.col("reference_known") > 0, "ok").otherwise("error"))


def delta_report(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, by: str, date: str | None = None) -> DataFrame:
    """Totals, net and absolute change, changed and nonzero rows of a table before and after, by one column.

    With `date` (one of the keys), also the first and last date of nonzero values on either side.
    """
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    both = a.join(b, list(keys), "full").fillna(0.0, ["before", "after"])
    d = F.col("after") - F.col("before")
    nonzero = [F.count_if(F.col(side) != 0).alias(f"nonzero_{side}") for side in ("before", "after")]
    dates = [f(F.when(F.col(side) != 0, F.col(date))).alias(f"{name}_{side}") for name, f in (("first", F.min), ("last", F.max)) for side in ("before", "after")] if date else []
    return both.groupBy(by).agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum(d).alias("net_delta"), F.sum(F.abs(d)).alias("absolute_delta"), F.count_if(d != 0).alias("changed_rows"), *nonzero, *dates)


def year_distribution(df: DataFrame, date: str, value: str, reference_year: int) -> DataFrame:
    """Rows and totals by year, and whether the year is the reference."""
    out = df.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("rows"), F.sum(value).alias("total"))
    return out.withColumn("is_reference", F.col("year") == reference_year)


def unexpected_values(df: DataFrame, series: str, value: str, expected: Mapping[str, str]) -> DataFrame:
    """Value of each series and whether it is not the one expected."""
    pairs = F.create_map(*[F.lit(x) for p in expected.items() for x in p])
    out = df.groupBy(series).agg(F.min(value).alias("value"), F.countDistinct(value).alias("values"))
    return out.withColumn("unexpected", ~F.coalesce(F.try_element_at(pairs, F.col(series)) == F.col("value"), F.lit(False)) | (F.col("values") > 1))

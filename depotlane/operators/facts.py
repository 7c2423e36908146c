"""Daily and weekly facts of services, picking and open requests."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from depotlane.functions.text import code_type, concept_class, decide, first_date, flow_of, monday, normalize_text

PREFERRED = {"delivery": ["service_date"], "pickup": ["service_date"]}
FALLBACK = {"delivery": ["event_start", "event_end"], "pickup": ["event_end", "event_start"]}


def with_class(df: DataFrame, code: str) -> DataFrame:
    """Adds service_type, service_class and reason; each text is normalised once, in steps that the optimiser keeps apart."""
    out = df.withColumns({"_concept": normalize_text(F.col("concept")), "_action": normalize_text(F.col("action")), "_kind": code_type(F.col(code))})
    out = out.withColumns({"_flow": flow_of(F.col("_action")), "_words": concept_class(F.col("_concept"))})
    out = out.withColumn("_s", decide(F.col("_kind"), F.col("_flow"), F.col("_words")))
    return out.select("*", "_s.*").drop("_concept", "_action", "_kind", "_flow", "_words", "_s")


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Request lines with service type and class, and the target date with its field and rank."""
    bucket = F.when((F.col("service_type") == "EGE") | (F.col("service_class") == "pickup"), "pickup").otherwise("delivery")
    out = with_class(requests, "generic_code").withColumn("_bucket", bucket)
    return out.withColumn("d", first_date(PREFERRED, FALLBACK, F.col("_bucket"))).select("*", "d.*").drop("d", "_bucket")


#: Timestamps of a request line, of which the greatest tells how new its version is; those that a table lacks are left out.
VERSIONS = ("modified_at", "line_modified_at", "order_created_at", "request_created_at", "created_date")
TYPES, CLASSES = ("EGE", "SGE", "SGP", "UNK"), ("UNK", "delivery", "pickup")
_RANKS, _SECONDS, _DAYS = 2**3, 2**33, 2**17


class Choice:
    """The order of versions as one positive number: the best date field, the newest change, the latest date, then names.

    Fixed-width parts follow each other: rank (3 bits), seconds and days since 1900 counted down (33 and
    17 bits, up to 2172 and 2258; beyond these limits all count as the limit), type, class, field and fallback. Its least value
    is found by hash aggregation, where a struct with strings would be sorted.
    """

    def __init__(self, fields: Sequence[str]):
        self.parts = (("service_type", TYPES), ("service_class", CLASSES), ("field", tuple(sorted(set(fields)))))
        self.size = math.prod(len(names) for _, names in self.parts)

    def of(self, version: Column) -> Column:
        within = lambda c, size: F.least(F.greatest(c, F.lit(0)), F.lit(size - 1)).cast("long")
        seconds = F.coalesce(F.unix_timestamp(version) - F.unix_timestamp(F.lit("1900-01-01").cast("timestamp")), F.lit(0))
        out = within(F.col("rank"), _RANKS)
        out = out * _SECONDS + (_SECONDS - 1 - within(seconds, _SECONDS))
        out = out * _DAYS + (_DAYS - 1 - within(F.datediff("date", F.lit("1900-01-01").cast("date")), _DAYS))
        for column, names in self.parts:
            out = out * len(names) + (F.array_position(F.array(*map(F.lit, names)), F.col(column)) - 1)
        return out * 2 + F.col("fallback").cast("long")

    def taken(self, key: Column) -> dict[str, Column]:
        """The columns that a key stands for, but the date."""
        out, rest = {"fallback": key % 2 == 1}, F.shiftright(key, 1) % self.size
        for column, names in reversed(self.parts):
            out[column] = F.element_at(F.array(*map(F.lit, names)), (rest % len(names) + 1).cast("int"))
            rest = F.floor(rest / len(names))
        return out


def request_level(lines: DataFrame, items: DataFrame, versions: Sequence[str] = VERSIONS) -> DataFrame:
    """One row per request: sums of its lines, and the date of its latest valid version.

    The version is the one with a date, the best field, the greatest of its timestamps (to the second, 1900 without
    any), the latest date; further ties fall to the first of the other columns, so the choice is the same each time.
    """
    choice = Choice([f for names in (*PREFERRED.values(), *FALLBACK.values()) for f in names])
    stamps = [F.col(c).cast("timestamp") for c in versions if c in lines.columns]
    newest = F.greatest(*stamps) if len(stamps) > 1 else stamps[0] if stamps else F.lit(None).cast("timestamp")
    own = lines.join(items.select("sku", "kilos", "m3"), "sku", "left").withColumn("key", choice.of(newest))
    # a filter on the date would be pushed below the projections and repeat there all that leads to it
    dated = lambda c: F.when(F.col("date").isNotNull(), c)
    units = F.coalesce("requested_quantity", F.lit(0.0))
    out = own.groupBy("generic_code").agg(
        F.count("date").alias("lines"), F.countDistinct(dated(F.col("sku"))).alias("items"), F.sum(dated(units)).alias("units"), F.sum(dated(units * F.coalesce("kilos", F.lit(0.0)))).alias("kg"),
        F.sum(dated(units * F.coalesce("m3", F.lit(0.0)))).alias("m3"), F.min(dated(F.col("created_date"))).alias("created_date"), F.min(dated(F.col("key"))).alias("key"), F.min_by("date", dated(F.col("key"))).alias("date"),
    ).where("lines > 0")
    found = choice.taken(F.col("key"))
    return out.select(*[c for c in out.columns if c not in ("key", "date")], "date", *[found[c].alias(c) for c in ("service_type", "service_class", "field", "fallback")]).withColumn("lead_days", F.datediff("date", "created_date"))


def _counts() -> list[Column]:
    kind, way = F.col("service_type"), F.col("service_class")
    return [
        F.count_if((kind == "SGE") & (way == "delivery")).alias("deliveries_sge"), F.count_if((kind == "SGP") & (way == "delivery")).alias("deliveries_sgp"), F.count_if((kind == "EGE") & (way == "pickup")).alias("pickups_ege"),
        F.count_if(way == "delivery").alias("deliveries"), F.count_if(way == "pickup").alias("pickups"), F.count("*").alias("services"),
    ]


def services_from_notes(notes: DataFrame) -> DataFrame:
    """Daily services from delivery notes: counts, urgencies, weights (sums null if all are), spread of billable weight."""
    urgent = [F.count_if(F.col("urgency_value") == u).alias(f"urgency_{u.lower()}") for u in ("NO", "SI", "MUY_URGENTE", "UNKNOWN")]
    sums = [x for c in ("weight_kg", "volume_m3", "billable_kg") for x in (F.sum(c).alias(f"sum_{c}"), F.avg(F.col(c).isNull().cast("int")).alias(f"missing_{c}"))]
    spread = [F.avg("billable_kg").alias("mean_billable"), *[F.percentile("billable_kg", F.lit(q)).alias(f"p{int(q * 100)}_billable") for q in (0.5, 0.9, 0.95)]]
    out = notes.where("service_date is not null").groupBy(F.col("service_date").alias("date")).agg(*_counts(), *urgent, *sums, *spread)
    return out.withColumns({"source": F.lit("notes"), "truth": F.lit("final")})


def services_from_requests(requests: DataFrame) -> DataFrame:
    """Daily services from request-level rows."""
    out = requests.groupBy("date").agg(*_counts(), *[F.sum(c).alias(c) for c in ("lines", "items", "units", "kg", "m3")])
    return out.withColumns({"source": F.lit("requests"), "truth": F.lit("visible")})


def hybrid_services(a: DataFrame, b: DataFrame, switch_date: str) -> DataFrame:
    """Rows of `a` before the switch date and of `b` from it; one row for each date."""
    switch = F.lit(switch_date).cast("date")
    return a.where(F.col("date") < switch).unionByName(b.where(F.col("date") >= switch), allowMissingColumns=True)


def freshness(a: DataFrame, b: DataFrame, hybrid: DataFrame, switch_date: str) -> DataFrame:
    """metric, value (text): last dates, days of each source, days that both have from the switch on."""
    switch = F.lit(switch_date).cast("date")
    last = lambda df, name: df.agg(F.max("date").cast("string").alias("value")).select(F.lit(name).alias("metric"), "value")
    days = hybrid.groupBy(F.concat(F.lit("days_from_"), F.col("source")).alias("metric")).agg(F.count("*").cast("string").alias("value"))
    both = a.where(F.col("date") >= switch).select("date").intersect(b.where(F.col("date") >= switch).select("date"))
    out = last(a, "last_notes").unionByName(last(b, "last_requests")).unionByName(last(hybrid, "last_hybrid")).unionByName(days)
    return out.unionByName(both.agg(F.count("*").cast("string").alias("value")).select(F.lit("overlap_days").alias("metric"), "value"))


def picking_daily(movements: DataFrame, items: DataFrame, heavy_kg: float = 15.0, bulky_m3: float = 0.125) -> DataFrame:
    """Daily picking: lines, units, items, weight, volume, shares of heavy and bulky lines, share with item data."""
    known = items.select("sku", "kilos", "m3").withColumn("known", F.lit(1))
    own = movements.where("movement_type = 'PI' and operational_date is not null").join(known, "sku", "left").fillna(0.0, ["kilos", "m3", "quantity"]).fillna(0, ["known"])
    return own.groupBy(F.col("operational_date").alias("date")).agg(
        F.count("*").alias("lines"), F.sum("quantity").alias("units"), F.countDistinct("sku").alias("items"), F.sum(F.col("quantity") * F.col("kilos")).alias("kg"), F.sum(F.col("quantity") * F.col("m3")).alias("m3"),
        F.avg((F.col("kilos") >= heavy_kg).cast("int")).alias("heavy_share"), F.avg((F.col("m3") >= bulky_m3).cast("int")).alias("bulky_share"), F.avg("known").alias("known_share"),
    )


def other_movements_daily(movements: DataFrame) -> DataFrame:
    """Daily receipts and put-aways."""
    return movements.groupBy(F.col("operational_date").alias("date")).pivot("movement_type", ["CR", "EP"]).count().fillna(0).where("CR + EP > 0")


def backlog(requests: DataFrame) -> DataFrame:
    """Requests, lines, items, units, weight and volume by target date, type and class."""
    return requests.groupBy("date", "service_type", "service_class").agg(F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in ("lines", "items", "units", "kg", "m3")])


def backlog_by_horizon(requests: DataFrame, most: int = 28, as_of: bool = False) -> DataFrame:
    """Requests due 1 to `most` days after each snapshot date; as_of counts only those that existed then."""
    own = requests.where("created_date is not null and date is not null").groupBy("date", "service_type", "created_date").agg(F.count("*").alias("n"))
    own = own.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("snapshot", F.expr("date_sub(date, horizon)"))
    if as_of:
        own = own.where("created_date <= snapshot")
    return own.groupBy("snapshot", "horizon", "service_type").agg(F.sum("n").alias("requests"))


def weekly(df: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Sums of additive columns by Monday."""
    return df.groupBy(monday(F.col(date)).alias("week")).agg(*[F.sum(c).alias(c) for c in columns])


def actuals_daily(fact: DataFrame, columns: Sequence[str], source: str = "notes", truth: str = "final") -> DataFrame:
    """Long table of every day from first to last and each KPI, 0 where the fact has no row."""
    bounds = fact.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("date"))
    out = days.join(fact.select("date", *columns), "date", "left").fillna(0, list(columns))
    out = out.select("date", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["date"], list(columns), "kpi", "actual_value")
    return out.withColumns({"actual_source": F.lit(source), "actual_truth": F.lit(truth)})


def service_actuals(fact: DataFrame, columns: Mapping[str, str], switched: str = "requests") -> DataFrame:
    """Long table of every day and KPI of a hybrid fact (date, source, truth, counts), 0 where it has no row.

    Days without a row take the labels of their side of the switch: the first day whose source is `switched`.
    """
    bounds = fact.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.min(F.when(F.col("source") == switched, F.col("date"))).alias("switch"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("date"), "switch")
    out = days.join(fact.select("date", "source", "truth", *[F.col(c).cast("double").alias(k) for k, c in columns.items()]), "date", "left").fillna(0.0, list(columns))
    early = F.coalesce(F.col("date") < F.col("switch"), F.lit(True))
    out = out.withColumns({"actual_source": F.coalesce("source", F.when(early, "notes").otherwise(switched)), "actual_truth": F.coalesce("truth", F.when(early, "final").otherwise("visible"))})
    return out.select("date", "actual_source", "actual_truth", *columns).unpivot(["date", "actual_source", "actual_truth"], list(columns), "kpi", "actual_value")


def actuals_weekly(daily: DataFrame) -> DataFrame:
    """Weekly sums; a label is kept where all days agree on it (null counting as a value), else mixed."""
    one = lambda c: F.when((F.count_if(F.col(c).isNull()) == 0) & (F.min(c) == F.max(c)), F.min(c)).when(F.count(c) == 0, F.lit(None)).otherwise("mixed").alias(c)
    return daily.groupBy(monday(F.col("date")).alias("week"), "kpi").agg(F.sum("actual_value").alias("actual_value"), one("actual_source"), one("actual_truth"))


def kpi_cards(actuals: DataFrame, forecasts: DataFrame, groups: dict[str, str], year: int, quarter: int | None = None) -> DataFrame:
    """Totals of KPI groups: actual, forecast, and their difference in percent; null where all are null."""
    pairs = F.create_map(*[F.lit(x) for p in groups.items() for x in p])
    both = actuals.select("date", "kpi", F.col("actual_value").alias("actual")).join(forecasts.select("date", "kpi", "forecast_value"), ["date", "kpi"], "full")
    both = both.where(F.year("date") == year)
    if quarter:
        both = both.where(F.quarter("date") == quarter)
    out = both.groupBy(F.coalesce(F.try_element_at(pairs, F.col("kpi")), F.col("kpi")).alias("group")).agg(F.sum("actual").alias("actual"), F.sum("forecast_value").alias("forecast"))
    return out.withColumns({"headline": F.coalesce("actual", "forecast"), "delta_pct": F.try_divide(F.col("actual") - F.col("forecast"), F.col("forecast"))})


def group_points(forecasts: DataFrame, compared: DataFrame, groups: Mapping[str, str], quarters: Sequence[int]) -> DataFrame:
    """(date, group, actual, forecast, reference): null-preserving sums of KPI groups, of the latest year of both tables and the quarters.

    forecasts: date, kpi, forecast_value; compared: date, kpi, actual, reference, as of the year-on-year tables. KPIs
    without a group are left out; points without any value too.
    """
    pairs = F.create_map(*[F.lit(x) for p in groups.items() for x in p])
    both = compared.select("date", "kpi", "actual", "reference").join(forecasts.select("date", "kpi", F.col("forecast_value").alias("forecast")), ["date", "kpi"], "full")
    own = both.withColumn("group", F.try_element_at(pairs, F.col("kpi"))).where(F.col("group").isNotNull() & F.quarter("date").isin(*quarters))
    year = both.agg(F.max(F.year("date")).alias("year"))
    out = own.join(F.broadcast(year), F.year("date") == F.col("year"))  # one row
    out = out.groupBy("date", "group").agg(*[F.sum(c).alias(c) for c in ("actual", "forecast", "reference")])
    return out.where("actual is not null or forecast is not null or reference is not null")


def cards(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """A card for each group: totals, the first of actual, forecast and reference that it has, and its actual's distance from the others."""
    wanted = points.sparkSession.createDataFrame([(n,) for n in names], "group string")
    out = wanted.join(points.groupBy("group").agg(*[F.sum(c).alias(c) for c in ("actual", "forecast", "reference")]), "group", "left")
    label = F.when(F.col("actual").isNotNull(), "actual").when(F.col("forecast").isNotNull(), "forecast").when(F.col("reference").isNotNull(), "reference").otherwise("none")
    delta = lambda c: F.try_divide(F.col("actual") - F.col(c), F.abs(c))
    return out.withColumns({"headline": F.coalesce("actual", "forecast", "reference"), "headline_from": label, "forecast_delta": delta("forecast"), "reference_delta": delta("reference")})

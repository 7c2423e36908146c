"""Queries on text, quality, joins, facts and calendar features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from depotlane.functions import text as t
from depotlane.lineage import cut, scratch
from depotlane.operators import calendar, enrich, facts, quality
from depotlane.sources import files, normalize, staging
from depotlane.sources.staging import CTES

SWITCH, START, END = "2000-01-01", "1995-01-01", "2001-12-31"
#: A fixed list of holidays, the same in both engines.
HOLIDAYS = [(f"{y}-{d}", n, r, c) for y in range(1995, 2002) for d, n, r, c in (("01-01", "N", None, None), ("05-02", None, "R", None), ("05-15", None, None, "C"), ("10-12", "N", None, None), ("12-06", "N", None, None), ("12-08", "N", None, None), ("12-25", "N", None, None))]


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def text_normalize(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(t.normalize_text(F.col("text")), 256).alias("text_sha256"))


def text_codes(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.concat(F.lit(" 00"), F.col("l_partkey").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, ".0").otherwise(" ")).alias("raw"))
    return raw.select("l_orderkey", "l_linenumber", t.normalize_code(F.col("raw")).alias("code"), t.canonical_identifier(F.col("raw")).alias("identifier"), t.number(F.col("raw")).alias("number"))


def text_dates(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.when(F.col("o_orderkey") % 5 == 0, "31/02/1999").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")).alias("raw"), "o_orderdate")
    parsed = t.day_first(F.col("raw"))
    d = F.to_date("o_orderdate")
    return raw.select("o_orderkey", F.to_date(parsed).alias("parsed"), t.regime(d, 1999, 2000).alias("regime"), t.monday(d).alias("monday"), t.same_day_in(d, 1996).alias("same_day"), t.monday_of_iso(F.year(d), F.weekofyear(d)).alias("iso_monday"), F.to_date(t.day_first(F.col("day"))).alias("day"))


def service_classes(spark, sf_dir):
    return facts.with_class(staging.notes(spark, sf_dir), "service_code").withColumn("u", t.mapped(F.col("urgency"))).select(
        "service_code", "service_type", "service_class", "reason", F.col("u.value").alias("urgency"), F.col("u.missing").alias("urgency_missing"), t.billable_weight(F.col("weight_kg"), F.col("volume_m3")).alias("billable_kg")
    )


def request_dates(spark, sf_dir):
    return facts.prepare_requests(staging.requests(spark, sf_dir)).select("generic_code", "sku", "service_type", "service_class", "reason", "date", "field", "rank", "fallback", "missing")


def quality_nulls(spark, sf_dir):
    return _round(quality.null_profile(staging.movements(spark, sf_dir), ["sku", "owner", "external_order_id", "location", "completed_at", "quantity"]), "null_pct")


def quality_issues(spark, sf_dir):
    model = (F.col("movement_type") == "PI") & F.col("external_order_id").isNotNull() & (F.col("quantity") > 0)
    out = quality.issues(staging.movements(spark, sf_dir), ["external_order_id", "location"], "quantity", ["external_order_id", "owner", "sku", "quantity", "location"], model)
    return _round(out, "share")


def quality_stages(spark, sf_dir):
    keys = F.col("external_order_id").isNotNull() & F.col("sku").isNotNull() & F.col("owner").isNotNull()
    return _round(quality.stages(staging.movements(spark, sf_dir), {"picks": F.col("movement_type") == "PI", "keys": keys, "quantity": F.col("quantity") > 0, "dated": F.col("completed_at").isNotNull()}), "share")


def quality_movements(spark, sf_dir):
    raw = staging.movements(spark, sf_dir).withColumn("ended", F.when(F.col("quantity") % 7 == 0, "31/02/1999").when(F.col("quantity") % 5 != 0, F.date_format("completed_at", "dd/MM/yyyy")))
    return _round(quality.movement_qa(raw, {"ended": t.day_first(F.col("ended"))}), "value")


def quality_duplicates(spark, sf_dir):
    return quality.potential_duplicates(staging.requests(spark, sf_dir), ["generic_code", "sku"]).select("generic_code", "sku", "requested_quantity", "modified_at", "group_size")


def quality_deduplicated(spark, sf_dir):
    kept, removed = quality.drop_duplicates(staging.movements(spark, sf_dir).select("owner", "sku", "location"), ["owner", "sku", "location"])
    return kept.crossJoin(F.broadcast(removed))  # one row


def quality_model_rows(spark, sf_dir):
    kept, out = quality.model_filter(staging.movements(spark, sf_dir), ["external_order_id", "sku", "owner"])
    columns = ["movement_type", "external_order_id", "sku", "owner", "quantity"]
    return kept.select(*columns, F.lit("kept").alias("state")).unionByName(out.select(*columns, F.col("excluded_because").alias("state")))


def quality_unexpected(spark, sf_dir):
    kinds = facts.with_class(staging.notes(spark, sf_dir), "service_code").withColumn("series", F.substring("service_code", 1, 3))
    return quality.unexpected_values(kinds, "series", "service_type", {"SGP": "SGP", "SGE": "SGE", "EGE": "SGE"})


def quality_top_values(spark, sf_dir):
    return quality.top_values(staging.movements(spark, sf_dir), "location")


def quality_classes(spark, sf_dir):
    return _round(quality.classification_qa(service_classes(spark, sf_dir), concept="service_type"), "share")


def quality_date_fields(spark, sf_dir):
    return _round(quality.date_field_usage(request_dates(spark, sf_dir)), "fallback_pct", "missing_pct", "share")


def quality_unknown_concepts(spark, sf_dir):
    return _round(quality.unknown_concepts(facts.with_class(staging.requests(spark, sf_dir), "generic_code")), "unknown_pct")


def _versions(spark, sf_dir):
    """Request lines with target dates, and the greatest of their timestamps."""
    return facts.prepare_requests(staging.requests(spark, sf_dir)), F.greatest(*[F.col(c).cast("timestamp") for c in facts.VERSIONS])


def quality_several_dates(spark, sf_dir):
    lines, version = _versions(spark, sf_dir)
    return _round(quality.several_dates(lines, "generic_code", "date", version), "share", "moved_share")


def quality_most_moved(spark, sf_dir):
    lines, version = _versions(spark, sf_dir)
    return quality.most_moved(lines, "generic_code", "date", version)


def quality_years(spark, sf_dir):
    return quality.year_distribution(staging.movements(spark, sf_dir), "operational_date", "quantity", 2000)


def quality_delta(spark, sf_dir):
    fact = facts.weekly(facts.picking_daily(staging.movements(spark, sf_dir), staging.items(spark, sf_dir)), ["lines", "units"])
    long = fact.select("week", F.col("lines").cast("double").alias("lines"), "units").unpivot(["week"], ["lines", "units"], "kpi", "value")
    return quality.delta_report(long, long.withColumn("value", F.when(F.month("week") == 1, F.col("value") + 1).otherwise(F.col("value"))), ["week", "kpi"], "value", "kpi", "week")


#: Orders of two movements in three by what was moved; some stand for two orders.
_LOOKUP = {k: staging.MOVEMENTS[k] for k in enrich.LOOKUP_KEYS} | {
    "order_id": "CAST(l_orderkey AS STRING)", "external_order_id": "CASE WHEN l_linenumber % 5 <> 4 THEN 'E' || CAST(l_orderkey AS STRING) END", "client": "'K' || CAST(o_custkey AS STRING)", "external_client": "CASE WHEN o_custkey % 2 = 0 THEN 'X' || CAST(o_custkey AS STRING) END",
}
_FILLED = {"client": "CASE WHEN l_linenumber % 2 = 0 THEN 'own' END", "order_id": "CAST(NULL AS STRING)", "external_client": "CAST(NULL AS STRING)"}


def join_lookup_fill(spark, sf_dir):
    lines = staging._lines(spark, sf_dir)
    lookup = staging._select(lines.where("l_linenumber % 3 <> 1"), _LOOKUP)
    lookup = lookup.unionByName(lookup).unionByName(staging._select(lines.where("l_linenumber = 2 and l_orderkey % 4 = 0"), _LOOKUP | {"external_order_id": "'other'"}))
    moved = staging._select(lines, staging.MOVEMENTS | _FILLED)
    return enrich.fill_orders(moved, lookup).select("movement_type", *enrich.LOOKUP_KEYS, *enrich.LOOKUP_FILL, "source", "enriched")


def join_impute(spark, sf_dir):
    out = enrich.impute_single(staging.requests(spark, sf_dir), "generic_code", "service_date")
    return out.select("generic_code", "sku", "service_date", "imputed")


def _matched(spark, sf_dir):
    notes = staging.notes(spark, sf_dir).withColumnRenamed("order_code", "external_order_id").select("external_order_id", "service_code", F.col("service_date").alias("note_date"))
    return enrich.match(staging.movements(spark, sf_dir), notes, ["external_order_id"], "has_note", [F.col("note_date"), F.col("service_code")])


def join_notes(spark, sf_dir):
    return _matched(spark, sf_dir).select("external_order_id", "owner", "sku", "quantity", "note_date", "service_code", "has_note")


def join_coverage(spark, sf_dir):
    out = quality.join_coverage(_matched(spark, sf_dir).withColumn("type", F.substring("service_code", 1, 2)), "has_note", "type")
    return _round(out, "matched_pct")


def _requests_matched(spark, sf_dir):
    """Request lines with the note of their code."""
    notes = staging.notes(spark, sf_dir).select(F.col("service_code").alias("generic_code"), F.col("service_date").alias("note_date"), "urgency")
    return enrich.match(staging.requests(spark, sf_dir), notes, ["generic_code"], "has_note", [F.col("note_date"), F.col("urgency")])


def join_request_notes(spark, sf_dir):
    return _requests_matched(spark, sf_dir).select("generic_code", "sku", "requested_quantity", "note_date", "urgency", "has_note")


def join_request_items(spark, sf_dir):
    items = staging.items(spark, sf_dir).where("cast(sku as int) % 11 != 0")
    out = enrich.match(staging.requests(spark, sf_dir), items, ["sku"], "has_item", [F.col("sku_name"), F.col("category"), F.col("kilos"), F.col("m3")])
    return out.select("generic_code", "sku", "sku_name", "kilos", "m3", (F.col("requested_quantity") * F.col("kilos")).alias("kg"), "has_item")


def join_unmatched_aligned(spark, sf_dir):
    return quality.unmatched_aligned(_matched(spark, sf_dir), "external_order_id", _requests_matched(spark, sf_dir), "generic_code", "has_note")


def join_unmatched(spark, sf_dir):
    return quality.unmatched_keys(staging.requests(spark, sf_dir), staging.notes(spark, sf_dir).withColumnRenamed("service_code", "generic_code"), "generic_code")


def join_best_item(spark, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/part.parquet")
    return enrich.best_row(src, ["p_name"], [F.col("p_size").desc(), F.col("p_retailprice").desc(), F.col("p_partkey")])


def join_open_requests(spark, sf_dir):
    level = cut(_level(spark, sf_dir))
    span = level.agg(F.min("created_date").alias("a"), F.max("created_date").alias("b"))
    origins = span.select(F.explode(F.expr("sequence(a, b, interval 7 day)")).alias("origin"))
    return enrich.open_at(level, origins, "created_date", "date", ["service_type"], ["lines", "units"])


def join_as_of(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_suppkey % 5 as kpi", "cast(l_shipdate as date) as target_date", "date_sub(cast(l_shipdate as date), l_linenumber % 4) as run_date", "l_orderkey * 10 + l_linenumber as emitted", "l_quantity as value")
    rows = rows.groupBy("kpi", "target_date", "run_date", "emitted").agg(F.max("value").alias("value"))
    return enrich.latest_before(rows, ["kpi"], "value", "run_date", "target_date", "emitted")


def join_key_difference(spark, sf_dir):
    return enrich.keys_without(staging.stock(spark, sf_dir), staging.movements(spark, sf_dir).where("operational_date >= date'2001-06-01'"), ["sku"])


def join_unique_notes(spark, sf_dir):
    return enrich.unique_notes_weekly(facts.with_class(staging.notes(spark, sf_dir), "service_code"))


def _level(spark, sf_dir):
    return facts.request_level(facts.prepare_requests(staging.requests(spark, sf_dir)), staging.items(spark, sf_dir))


def _notes(spark, sf_dir):
    return facts.with_class(staging.notes(spark, sf_dir), "service_code").withColumns({"urgency_value": t.mapped(F.col("urgency"))["value"], "billable_kg": t.billable_weight(F.col("weight_kg"), F.col("volume_m3")).cast("double")})


def fact_requests(spark, sf_dir):
    return _level(spark, sf_dir)


def fact_services_notes(spark, sf_dir):
    return _round(facts.services_from_notes(_notes(spark, sf_dir)), "missing_weight_kg", "missing_volume_m3", "missing_billable_kg", "mean_billable", "p50_billable", "p90_billable", "p95_billable")


def fact_services_requests(spark, sf_dir):
    return facts.services_from_requests(_level(spark, sf_dir))


def fact_services_hybrid(spark, sf_dir):
    out = facts.hybrid_services(facts.services_from_notes(_notes(spark, sf_dir)), facts.services_from_requests(_level(spark, sf_dir)), SWITCH)
    return out.select("date", "services", "deliveries", "pickups", "units", "source", "truth")


#: KPIs of services by the counts of a fact.
SERVICE_KPIS = {"sge": "deliveries_sge", "sgp": "deliveries_sgp", "ege": "pickups_ege"}


def fact_service_actuals(spark, sf_dir):
    hybrid = facts.hybrid_services(facts.services_from_notes(_notes(spark, sf_dir)), facts.services_from_requests(_level(spark, sf_dir)), SWITCH)
    return facts.service_actuals(hybrid.where("day(date) % 9 != 0"), SERVICE_KPIS)


def fact_freshness(spark, sf_dir):
    a, b = facts.services_from_notes(_notes(spark, sf_dir)), facts.services_from_requests(_level(spark, sf_dir))
    return facts.freshness(a, b, facts.hybrid_services(a, b, SWITCH), SWITCH)


def _picking(spark, sf_dir):
    return facts.picking_daily(staging.movements(spark, sf_dir), staging.items(spark, sf_dir))


def fact_picking(spark, sf_dir):
    return _round(_picking(spark, sf_dir), "heavy_share", "bulky_share", "known_share")


def fact_other_movements(spark, sf_dir):
    return facts.other_movements_daily(staging.movements(spark, sf_dir))


def fact_backlog(spark, sf_dir):
    return facts.backlog(_level(spark, sf_dir))


def fact_backlog_horizon(spark, sf_dir):
    return facts.backlog_by_horizon(_level(spark, sf_dir))


def fact_weekly(spark, sf_dir):
    return facts.weekly(_picking(spark, sf_dir), ["lines", "units", "kg", "m3"])


def fact_actuals_daily(spark, sf_dir):
    return facts.actuals_daily(_picking(spark, sf_dir), ["lines", "units"])


def fact_actuals_weekly(spark, sf_dir):
    daily = facts.actuals_daily(_picking(spark, sf_dir), ["lines", "units"]).withColumn("actual_source", F.when(F.col("date") >= SWITCH, "requests").otherwise("notes"))
    return facts.actuals_weekly(daily)


def fact_kpi_cards(spark, sf_dir):
    daily = facts.actuals_daily(_picking(spark, sf_dir), ["lines", "units", "items"])
    plan = daily.where("date >= date'1999-01-01'").select("date", "kpi", (F.col("actual_value") + 1).alias("forecast_value"))
    return _round(facts.kpi_cards(daily.where("kpi != 'items'"), plan, {"lines": "picking", "items": "picking"}, 1999, 2), "delta_pct")


def quality_prefixes(spark, sf_dir):
    return quality.prefix_frequencies(staging.requests(spark, sf_dir), "generic_code")


def _raw(spark, sf_dir, **columns):
    """Order lines as a raw export would show them: text under raw headers."""
    return staging._lines(spark, sf_dir).select(*[F.expr(e).alias(n.replace("_", " ")) for n, e in columns.items()])


def source_csv(spark, sf_dir):
    """Movements written as text under raw headers, read back, and put under the wanted names and types."""
    raw = staging.movements(spark, sf_dir).select(F.col("movement_type").alias("Tipo  Movimiento"), F.col("sku").alias("ARTÍCULO"), F.col("quantity").cast("string").alias("Cantidad"), F.col("operational_date").cast("string").alias("fecha"), F.lit("x").alias("other"))
    path = scratch(spark)
    files.write_table(raw, path, csv=True)
    read, _, lacking = files.canonical_columns(files.read_table(spark, f"{path}.csv"), {"movement_type": ["tipo movimiento"], "sku": ["articulo"], "quantity": ["cantidad"], "operational_date": ["fecha"], "owner": []})
    schema = StructType.fromDDL("operational_date date, movement_type string, sku long, quantity double, owner string")
    return files.project(read, schema).withColumn("lacking", F.lit(",".join(lacking)))


def source_parquet(spark, sf_dir):
    path = scratch(spark)
    files.write_table(staging.items(spark, sf_dir), path)
    return files.read_table(spark, f"{path}.parquet")


def source_top(spark, sf_dir):
    path = scratch(spark)
    files.write_top(staging.items(spark, sf_dir).select("sku", "sku_name", "kilos"), path, [F.col("kilos").desc(), "sku"], 500)
    return spark.read.schema("sku string, sku_name string, kilos double").json(path)


def normalize_movements(spark, sf_dir):
    raw = _raw(
        spark, sf_dir, Tipo_movimiento="case when l_returnflag = 'R' then ' cr' else 'pi ' end", Fecha_inicio="date_format(o_orderdate, 'dd/MM/yyyy HH:mm:ss')", Fecha_finalización="if(l_linenumber % 7 = 0, 'none', date_format(l_shipdate, 'd/M/yyyy'))",
        Artículo="concat(' 00', l_partkey, '.0')", Denominación_artículo="concat('  Ítem ', l_partkey)", Cantidad="cast(l_quantity as string)", Propietario="concat('c', o_custkey % 50)", Pedido_externo="if(l_suppkey % 10 = 0, ' ', concat(l_orderkey, '.0'))",
    )
    return normalize.movements(raw).select("movement_type", "started_at", "completed_at", "operational_date", "date_fallback", "duration_seconds", "sku", "sku_description", "quantity", "owner", "external_order_id", "external_order_id_source", "external_order_id_enriched", "transaction_id")


def normalize_lookup(spark, sf_dir):
    """Movements whose orders come from a raw lookup file, and no other."""
    keys = dict(Artículo="concat('0', l_partkey)", Fecha_finalización="date_format(l_shipdate, 'd/M/yyyy H:mm')", Cantidad="cast(l_quantity as string)", Propietario="concat('c', o_custkey % 50)", Paleta="concat('p', l_suppkey)")
    raw = _raw(spark, sf_dir, Tipo_movimiento="if(l_linenumber = 3, 'CR', 'PI')", Pedido_externo="if(l_linenumber = 2, 'own', '')", **keys)
    lookup = _raw(spark, sf_dir, Pedido="concat(l_orderkey, '.0')", Pedido_externo="concat('e', l_orderkey)", Cliente="concat('k', o_custkey)", **keys).where("`Pedido` not like '%7.0'")
    return normalize.movements(raw, normalize.columns(lookup, normalize.LOOKUP)).select("movement_type", *enrich.LOOKUP_KEYS, *enrich.LOOKUP_FILL, "external_order_id_source", "external_order_id_enriched", "transaction_id")


def normalize_requests(spark, sf_dir):
    raw = _raw(
        spark, sf_dir, Código_Genérico="concat('sge', o_orderkey)", Fecha_de_servicio="if(l_suppkey % 4 = 0, null, date_format(date_add(o_orderdate, cast(o_orderkey % 2 * (l_linenumber % 3) as int)), 'dd/MM/yyyy HH:mm:ss'))",
        Creación_solicitud="date_format(o_orderdate, 'dd/MM/yyyy HH:mm:ss')", Artículo="cast(l_partkey as string)", Acción="case l_linenumber % 3 when 0 then 'envío' when 1 then 'Recogida' end",
    ).withColumn("Cant. solicitada", F.lit("x"))
    return normalize.request_lines(raw).select("generic_code", "service_date", "service_date_imputed_from_request", "created_at", "sku", "action", "service_flow", "requested_quantity")


def normalize_items(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr("concat('0', p_partkey)").alias("Código"), F.col("p_name").alias("Nombre"), F.col("p_size").cast("string").alias("Kilos"))
    return normalize.items(raw.unionByName(raw).unionByName(raw.withColumn("Código", F.lit("")))).select("sku", "sku_name", "weight_kg", "m2")


def normalize_notes(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("concat(' sgp', o_orderkey) as `Descripción`", "date_format(o_orderdate, 'yyyy-MM-dd') as `Fecha servicio`", "lower(o_orderstatus) as Urgencia", "concat(o_custkey, '.5') as Volumen")
    return normalize.notes(raw).select("service_code", "description", "service_date", "urgency", "volume_m3", "weight_kg")


def normalize_stock(spark, sf_dir):
    raw = _raw(spark, sf_dir, Propie="concat('0', l_suppkey)", Art_y="if(l_linenumber = 1, '', cast(l_partkey as string))", Stock_pal="cast(l_quantity as string)", Ubicación="concat('s', l_suppkey)")
    return normalize.stock(raw, staging.SNAPSHOT).select("snapshot_date", "owner_code", "sku", "stock_quantity", "location", "occupancy_status")


def _days(spark):
    return calendar.dim_date(spark, START, END, spark.createDataFrame(HOLIDAYS, "date string, national string, region string, city string").withColumn("date", F.to_date("date")))


def calendar_days(spark, sf_dir):
    used = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("orders"))
    return _days(spark).join(used, "date")


def calendar_weeks(spark, sf_dir):
    used = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(t.monday(F.to_date("o_orderdate")).alias("week")).agg(F.count("*").alias("orders"))
    return _round(calendar.weekly_calendar(_days(spark)).join(used, "week"), "weekend_share")


def _series(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").cast("double").alias("target"))


def series_features(spark, sf_dir):
    out = calendar.add_lags(calendar.assemble(_series(spark, sf_dir), _days(spark)))
    return _round(out, "mean_7", "mean_14", "mean_28", "mean_same_weekday")


def series_labels(spark, sf_dir):
    """Series on the calendar with the labels around the switch; one series never switches."""
    series = _series(spark, sf_dir)
    switch = series.where(F.col("series") != "5-LOW").groupBy("series").agg(F.min(F.when(F.col("date") >= F.lit(SWITCH).cast("date"), F.col("date"))).alias("date"))
    return calendar.assemble(series, _days(spark), switch=switch)


def series_offsets(spark, sf_dir):
    level = _level(spark, sf_dir).select(F.regexp_extract("generic_code", "([0-9]+)$", 1).alias("code"), "service_type", F.col("date").alias("service_date"))
    picks = staging.movements(spark, sf_dir).where("movement_type = 'PI' and external_order_id is not null").select(F.col("external_order_id").alias("code"), F.date_add("operational_date", 0).alias("pick_date"), "quantity")
    return calendar.offsets_table(level, picks, 30).groupBy("service_type", "offset").agg(F.count("*").alias("lines"), F.sum("quantity").alias("units"))


QUERIES = {
    f.__name__: f
    for f in (
        text_normalize, text_codes, text_dates, service_classes, request_dates, quality_nulls, quality_issues, quality_duplicates, quality_stages, quality_movements, quality_deduplicated, quality_unexpected, quality_model_rows, quality_top_values, quality_classes, quality_date_fields, quality_several_dates, quality_most_moved, quality_unknown_concepts,
        quality_years, quality_delta, join_lookup_fill, join_impute, join_notes, join_coverage, join_request_notes, join_request_items, join_unmatched_aligned, join_unmatched, join_best_item, join_open_requests, join_as_of, join_key_difference, join_unique_notes, fact_requests, fact_services_notes,
        fact_services_requests, fact_services_hybrid, fact_service_actuals, fact_freshness, fact_picking, fact_other_movements, fact_backlog, fact_backlog_horizon, fact_weekly, fact_actuals_daily, fact_actuals_weekly, fact_kpi_cards, calendar_days,
        calendar_weeks, series_features, series_labels, series_offsets, quality_prefixes, source_csv, source_parquet, source_top, normalize_movements, normalize_lookup, normalize_requests, normalize_items, normalize_notes, normalize_stock,
    )
}


def _class(code, action, concept):
    kind = f"CASE WHEN {code} LIKE 'SGP%' THEN 'SGP' WHEN {code} LIKE 'SG%' THEN 'SGE' WHEN {code} LIKE 'EG%' THEN 'EGE' WHEN {code} LIKE 'DEGE%' THEN 'EGE' END"
    flow = f"CASE WHEN {action} IN ('ENVIO', 'ENTREGA') THEN 'delivery' WHEN {action} = 'RECOGIDA' THEN 'pickup' END"
    words = f"CASE WHEN regexp_matches({concept}, 'RECOGIDA|DEVOLUCION|RECEPCION|RETORNO') THEN 'pickup' WHEN regexp_matches({concept}, 'PORTE ENTREGA|PORTE ENVIO|EXPEDICION|ENTREGA') THEN 'delivery' END"
    usual = f"CASE WHEN ({kind}) = 'EGE' THEN 'pickup' WHEN ({kind}) IS NOT NULL THEN 'delivery' END"
    return f"""coalesce({kind}, 'UNK') AS service_type, coalesce({flow}, {usual}, {words}, 'UNK') AS service_class,
 CASE WHEN ({kind}) IS NOT NULL AND ({flow}) = ({usual}) THEN 'prefix and action' WHEN ({flow}) IS NOT NULL THEN 'action' WHEN ({kind}) IS NOT NULL THEN 'prefix' WHEN ({words}) IS NOT NULL THEN 'concept' ELSE 'unknown' END AS reason"""


_RQ = f"""WITH {CTES}, r0 AS (SELECT *, {_class('generic_code', 'action', 'concept')} FROM requests), r1 AS (SELECT *, service_type = 'EGE' OR service_class = 'pickup' AS pick FROM r0),
rq AS (SELECT *, CASE WHEN pick THEN coalesce(service_date, event_end, event_start) ELSE coalesce(service_date, event_start, event_end) END AS date,
 CASE WHEN service_date IS NOT NULL THEN 1 WHEN pick THEN CASE WHEN event_end IS NOT NULL THEN 2 WHEN event_start IS NOT NULL THEN 3 ELSE 999 END ELSE CASE WHEN event_start IS NOT NULL THEN 2 WHEN event_end IS NOT NULL THEN 3 ELSE 999 END END AS rank,
 CASE WHEN service_date IS NOT NULL THEN 'service_date' WHEN pick THEN CASE WHEN event_end IS NOT NULL THEN 'event_end' WHEN event_start IS NOT NULL THEN 'event_start' ELSE '<MISSING>' END ELSE CASE WHEN event_start IS NOT NULL THEN 'event_start' WHEN event_end IS NOT NULL THEN 'event_end' ELSE '<MISSING>' END END AS field FROM r1)"""
_LV = f"""{_RQ}, lv0 AS (SELECT generic_code, count(*) AS lines, count(DISTINCT sku) AS items, sum(requested_quantity) AS units, sum(requested_quantity * coalesce(kilos, 0)) AS kg, sum(requested_quantity * coalesce(i.m3, 0)) AS m3, min(created_date) AS created_date,
 arg_min({{'date': date, 'service_type': service_type, 'service_class': service_class, 'field': field, 'fallback': rank > 1}}, (rank, -epoch(greatest(modified_at, line_modified_at, order_created_at, request_created_at, created_date)), -(date - DATE '1970-01-01'), service_type, service_class, field)) AS v FROM rq LEFT JOIN items i USING (sku) WHERE date IS NOT NULL GROUP BY generic_code),
lv AS (SELECT * EXCLUDE (v), v.date AS date, v.service_type AS service_type, v.service_class AS service_class, v.field AS field, v.fallback AS fallback, (v.date - created_date)::INT AS lead_days FROM lv0)"""
_NT = f"""nt AS (SELECT *, {_class('service_code', 'action', 'concept')}, CASE urgency WHEN 'N' THEN 'NO' WHEN 'SI' THEN 'SI' WHEN 'MUY URGENTE' THEN 'MUY_URGENTE' ELSE 'UNKNOWN' END AS u, ceil(greatest(coalesce(weight_kg, 0), coalesce(volume_m3, 0) * 270))::BIGINT AS billable_kg FROM notes)"""
_CNT = """count(*) FILTER (service_type = 'SGE' AND service_class = 'delivery') AS deliveries_sge, count(*) FILTER (service_type = 'SGP' AND service_class = 'delivery') AS deliveries_sgp, count(*) FILTER (service_type = 'EGE' AND service_class = 'pickup') AS pickups_ege,
 count(*) FILTER (service_class = 'delivery') AS deliveries, count(*) FILTER (service_class = 'pickup') AS pickups, count(*) AS services"""
_SN = f"""sn AS (SELECT service_date AS date, {_CNT}, count(*) FILTER (u = 'NO') AS urgency_no, count(*) FILTER (u = 'SI') AS urgency_si, count(*) FILTER (u = 'MUY_URGENTE') AS urgency_muy_urgente, count(*) FILTER (u = 'UNKNOWN') AS urgency_unknown,
 sum(weight_kg) AS sum_weight_kg, round(avg((weight_kg IS NULL)::INT), 6) AS missing_weight_kg, sum(volume_m3) AS sum_volume_m3, round(avg((volume_m3 IS NULL)::INT), 6) AS missing_volume_m3, sum(billable_kg)::DOUBLE AS sum_billable_kg, 0.0::DOUBLE AS missing_billable_kg,
 round(avg(billable_kg), 6) AS mean_billable, round(quantile_cont(billable_kg, 0.5), 6) AS p50_billable, round(quantile_cont(billable_kg, 0.9), 6) AS p90_billable, round(quantile_cont(billable_kg, 0.95), 6) AS p95_billable, 'notes' AS source, 'final' AS truth FROM nt GROUP BY service_date)"""
_SR = f"sr AS (SELECT date, {_CNT}, sum(lines)::BIGINT AS lines, sum(items)::BIGINT AS items, sum(units) AS units, sum(kg) AS kg, sum(m3) AS m3, 'requests' AS source, 'visible' AS truth FROM lv GROUP BY date)"
_HY = f"hy AS (SELECT date, services, deliveries, pickups, NULL::DOUBLE AS units, source, truth FROM sn WHERE date < DATE '{SWITCH}' UNION ALL SELECT date, services, deliveries, pickups, units, source, truth FROM sr WHERE date >= DATE '{SWITCH}')"
_PK = """pk AS (SELECT operational_date AS date, count(*) AS lines, sum(quantity) AS units, count(DISTINCT m.sku) AS items, sum(quantity * coalesce(kilos, 0)) AS kg, sum(quantity * coalesce(m3, 0)) AS m3, round(avg((coalesce(kilos, 0) >= 15)::INT), 6) AS heavy_share,
 round(avg((coalesce(m3, 0) >= 0.125)::INT), 6) AS bulky_share, round(avg((i.sku IS NOT NULL)::INT), 6) AS known_share FROM movements m LEFT JOIN items i ON i.sku = m.sku WHERE movement_type = 'PI' GROUP BY operational_date)"""
_WEEKLY = "SELECT date_trunc('week', date)::DATE AS week, sum(lines)::BIGINT AS lines, sum(units) AS units, sum(kg) AS kg, sum(m3) AS m3 FROM pk GROUP BY 1"
_ACT = f"""{_PK}, ad AS (SELECT unnest(generate_series((SELECT min(date) FROM pk), (SELECT max(date) FROM pk), INTERVAL 1 DAY))::DATE AS date),
al AS (SELECT date, kpi, coalesce(CASE kpi WHEN 'lines' THEN lines WHEN 'units' THEN units ELSE items END, 0)::DOUBLE AS actual_value FROM ad LEFT JOIN pk USING (date), (VALUES ('lines'), ('units'), ('items')) AS k(kpi))"""
_HOL = "hol AS (SELECT * FROM (VALUES " + ", ".join(f"(DATE '{d}', {n is not None and 1 or 0}, {r is not None and 1 or 0}, {c is not None and 1 or 0})" for d, n, r, c in HOLIDAYS) + ") AS h(date, n, r, c))"
_CAL = f"""{_HOL}, c0 AS (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY))::DATE AS date), c1 AS (SELECT date, coalesce(n, 0) AS holiday_national, coalesce(r, 0) AS holiday_region, coalesce(c, 0) AS holiday_city, greatest(coalesce(n, 0), coalesce(r, 0), coalesce(c, 0)) AS holiday, (isodow(date) >= 6)::INT AS weekend FROM c0 LEFT JOIN hol USING (date)),
ea AS (SELECT y, a, b, c, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM range(1995, 2002) AS t(y))), eb AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM ea),
ec AS (SELECT y, make_date(y, (h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114) // 31, (h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114) % 31 + 1) AS easter FROM eb),
cal AS (SELECT date, holiday_national, holiday_region, holiday_city, year(date)::INT AS year, quarter(date)::INT AS quarter, month(date)::INT AS month, day(date)::INT AS day, (isodow(date) - 1)::INT AS weekday, weekofyear(date)::INT AS iso_week, isoyear(date)::INT AS iso_year, ((day(date) - 1) // 7 + 1)::INT AS week_of_month, (last_day(date) = date)::INT AS month_end, weekend, holiday,
 coalesce(lead(holiday) OVER w, 0) AS pre_holiday, coalesce(lag(holiday) OVER w, 0) AS post_holiday, (greatest(holiday, weekend) = 0 AND coalesce(lag(greatest(holiday, weekend)) OVER w, 0) = 1 AND coalesce(lead(greatest(holiday, weekend)) OVER w, 0) = 1)::INT AS bridge, (date - easter)::INT AS easter_days, ((date - easter) BETWEEN 1 AND 6)::INT AS easter_week FROM c1 JOIN ec ON y = year(date) WINDOW w AS (ORDER BY date))"""
_FR = lambda w: f"(PARTITION BY series ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"

_MOV = """mo AS (SELECT generic_code, count(DISTINCT date) AS dates, min(date) AS first, max(date) AS last, arg_max(date, (greatest(modified_at, line_modified_at, order_created_at, request_created_at, created_date), date)) AS latest, (arg_max(date, (greatest(modified_at, line_modified_at, order_created_at, request_created_at, created_date), date)) - min(date))::INT AS shift
FROM rq WHERE date IS NOT NULL GROUP BY generic_code)"""

_N1 = "n1 AS (SELECT order_code, service_code, service_date AS note_date FROM notes WHERE order_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_code ORDER BY service_date, service_code) = 1)"
_N2 = "n2 AS (SELECT service_code AS generic_code, service_date AS note_date, urgency FROM notes QUALIFY row_number() OVER (PARTITION BY service_code ORDER BY service_date, urgency) = 1)"

ORACLES = {
    "text_normalize": r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(strip_accents(upper(replace(trim(text, ' '), 'ß', 'SS'))), '[^\x00-\x7F]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS text_sha256 FROM documents",
    "text_codes": "SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS code, '00' || l_partkey AS identifier, l_partkey::DOUBLE AS number FROM lineitem",
    "text_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS parsed, CASE year(o_orderdate) WHEN 1999 THEN 'off' WHEN 2000 THEN 'restart' ELSE 'normal' END AS regime, date_trunc('week', o_orderdate)::DATE AS monday, make_date(1996, month(o_orderdate), day(o_orderdate)) AS same_day, CASE WHEN isoyear(o_orderdate) = year(o_orderdate) THEN date_trunc('week', o_orderdate)::DATE ELSE CASE WHEN isoyear(date_trunc('week', make_date(year(o_orderdate), 1, 4)) + INTERVAL (7 * (weekofyear(o_orderdate) - 1)) DAY) = year(o_orderdate) THEN (date_trunc('week', make_date(year(o_orderdate), 1, 4)) + INTERVAL (7 * (weekofyear(o_orderdate) - 1)) DAY)::DATE END END AS iso_monday, o_orderdate::DATE AS day FROM orders",
    "service_classes": f"WITH {CTES}, {_NT} SELECT service_code, service_type, service_class, reason, u AS urgency, urgency IS NULL AS urgency_missing, billable_kg FROM nt",
    "request_dates": f"{_RQ} SELECT generic_code, sku, service_type, service_class, reason, date, field, rank, rank BETWEEN 2 AND 3 AS fallback, rank = 999 AS missing FROM rq",
    "quality_nulls": f"WITH {CTES}, n AS (SELECT count(*) AS rows, count(*) FILTER (sku IS NULL) AS sku, count(*) FILTER (owner IS NULL) AS owner, count(*) FILTER (external_order_id IS NULL) AS external_order_id, count(*) FILTER (location IS NULL) AS location, count(*) FILTER (completed_at IS NULL) AS completed_at, count(*) FILTER (quantity IS NULL) AS quantity FROM movements) SELECT \"column\", nulls, rows, round(nulls / rows, 6) AS null_pct FROM (UNPIVOT n ON sku, owner, external_order_id, location, completed_at, quantity INTO NAME \"column\" VALUE nulls)",
    "quality_issues": f"""WITH {CTES}, d AS (SELECT *, count(*) OVER (PARTITION BY external_order_id, owner, sku, quantity, location) AS g FROM movements), n AS (SELECT count(*) AS total, count(*) FILTER (external_order_id IS NULL) AS missing_external_order_id, count(*) FILTER (location IS NULL) AS missing_location, count(*) FILTER (quantity <= 0) AS non_positive_quantity, count(*) FILTER (g > 1) AS potential_duplicates, count(*) FILTER (movement_type = 'PI' AND external_order_id IS NOT NULL AND quantity > 0) AS model_rows FROM d)
SELECT issue, rows::BIGINT AS rows, round(rows / total, 6) AS share, CASE WHEN issue = 'model_rows' THEN 'info' WHEN rows / total > 0.10 THEN 'high' WHEN rows / total > 0.01 THEN 'medium' WHEN rows > 0 THEN 'low' ELSE 'none' END AS severity FROM (UNPIVOT n ON missing_external_order_id, missing_location, non_positive_quantity, potential_duplicates, model_rows INTO NAME issue VALUE rows)""",
    "quality_duplicates": f"WITH {CTES} SELECT generic_code, sku, requested_quantity, modified_at, count(*) OVER (PARTITION BY generic_code, sku) AS group_size FROM requests QUALIFY group_size > 1",
    "quality_stages": f"WITH {CTES}, c AS (SELECT count(*) AS \"all\", count(*) FILTER (a) AS picks, count(*) FILTER (a AND b) AS keys, count(*) FILTER (a AND b AND c) AS quantity, count(*) FILTER (a AND b AND c AND d) AS dated FROM (SELECT movement_type = 'PI' AS a, external_order_id IS NOT NULL AND sku IS NOT NULL AND owner IS NOT NULL AS b, quantity > 0 AS c, completed_at IS NOT NULL AS d FROM movements)) SELECT stage, rows, round(rows / (SELECT \"all\" FROM c), 6) AS share FROM (UNPIVOT c ON \"all\", picks, keys, quantity, dated INTO NAME stage VALUE rows)",
    "quality_movements": f"""WITH {CTES}, a AS (SELECT count(*)::DOUBLE AS rows, count(*) FILTER (quantity % 7 = 0)::DOUBLE AS unreadable_ended, avg((quantity IS NULL)::INT) AS missing_quantity_pct, avg((operational_date IS NULL)::INT) AS missing_date_pct, count(*) FILTER (movement_type = 'PI')::DOUBLE AS picks, avg((external_order_id IS NULL)::INT) FILTER (movement_type = 'PI') AS picks_without_order_pct FROM movements)
SELECT 'overall' AS section, key, round(value, 6) AS value FROM (UNPIVOT a ON rows, unreadable_ended, missing_quantity_pct, missing_date_pct, picks, picks_without_order_pct INTO NAME key VALUE value) UNION ALL SELECT * FROM (SELECT 'type', movement_type, count(*)::DOUBLE FROM movements GROUP BY 2 ORDER BY 3 DESC LIMIT 20)""",
    "quality_deduplicated": f"WITH {CTES}, d AS (SELECT DISTINCT owner, sku, location FROM movements) SELECT d.*, (SELECT count(*) FROM movements) - (SELECT count(*) FROM d) AS removed FROM d",
    "quality_unexpected": f"WITH {CTES}, {_NT} SELECT substr(service_code, 1, 3) AS series, min(service_type) AS value, count(DISTINCT service_type) AS values, NOT coalesce(min(service_type) = CASE substr(service_code, 1, 3) WHEN 'SGP' THEN 'SGP' WHEN 'SGE' THEN 'SGE' WHEN 'EGE' THEN 'SGE' END, false) OR count(DISTINCT service_type) > 1 AS unexpected FROM nt GROUP BY 1",
    "quality_model_rows": f"WITH {CTES} SELECT movement_type, external_order_id, sku, owner, quantity, CASE WHEN movement_type <> 'PI' THEN 'not a pick' WHEN external_order_id IS NULL OR sku IS NULL OR owner IS NULL THEN 'missing key' WHEN NOT quantity > 0 THEN 'quantity not positive' ELSE 'kept' END AS state FROM movements",
    "quality_top_values": f"WITH {CTES} SELECT coalesce(location, '<EMPTY>') AS value, count(*) AS count FROM movements GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "quality_classes": f"WITH {CTES}, {_NT}, k AS (SELECT service_class, service_code, row_number() OVER (PARTITION BY service_class ORDER BY service_code, service_type) AS k FROM nt) SELECT service_class, count(*) AS rows, string_agg(service_code, ',' ORDER BY service_code) FILTER (k <= 5) AS examples, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY service_class",
    "quality_date_fields": f"{_RQ} SELECT service_type, field, count(*) AS rows, round(avg((rank BETWEEN 2 AND 3)::INT), 6) AS fallback_pct, round(avg((rank = 999)::INT), 6) AS missing_pct, min(date) AS first_date, max(date) AS last_date, round(count(*) / sum(count(*)) OVER (PARTITION BY service_type), 6) AS share FROM rq GROUP BY service_type, field",
    "quality_several_dates": f"{_RQ}, {_MOV} SELECT count(*) AS codes, count(*) FILTER (dates > 1) AS with_several, round(avg((dates > 1)::INT), 6) AS share, round(coalesce(avg((shift <> 0)::INT) FILTER (dates > 1), 0), 6) AS moved_share, quantile_cont(shift, 0.5) FILTER (dates > 1)::DOUBLE AS median_shift, quantile_cont(shift, 0.9) FILTER (dates > 1)::DOUBLE AS p90_shift, max(shift) FILTER (dates > 1) AS max_shift FROM mo",
    "quality_most_moved": f"{_RQ}, {_MOV} SELECT * FROM mo WHERE dates > 1 ORDER BY shift DESC, generic_code LIMIT 20",
    "quality_unknown_concepts": f"{_RQ} SELECT concept, count(*) AS rows, (SELECT round(avg((service_class = 'UNK')::INT), 6) FROM rq) AS unknown_pct FROM rq WHERE service_class = 'UNK' GROUP BY concept ORDER BY rows DESC, concept LIMIT 50",
    "quality_years": f"WITH {CTES} SELECT year(operational_date)::INT AS year, count(*) AS rows, sum(quantity) AS total, year(operational_date) = 2000 AS is_reference FROM movements GROUP BY ALL",
    "quality_delta": f"WITH {CTES}, {_PK}, w AS ({_WEEKLY}), l AS (SELECT week, kpi, (CASE kpi WHEN 'lines' THEN lines ELSE units END)::DOUBLE AS v FROM w, (VALUES ('lines'), ('units')) AS k(kpi)), d AS (SELECT kpi, v AS b, CASE WHEN month(week) = 1 THEN v + 1 ELSE v END AS a, week FROM l) SELECT kpi, sum(b) AS before, sum(a) AS after, sum(a - b) AS net_delta, sum(abs(a - b)) AS absolute_delta, count(*) FILTER (a <> b) AS changed_rows, count(*) FILTER (b <> 0) AS nonzero_before, count(*) FILTER (a <> 0) AS nonzero_after, min(week) FILTER (b <> 0) AS first_before, min(week) FILTER (a <> 0) AS first_after, max(week) FILTER (b <> 0) AS last_before, max(week) FILTER (a <> 0) AS last_after FROM d GROUP BY kpi",
    "join_lookup_fill": f"""WITH l0 AS (SELECT l_linenumber, l_orderkey, {staging._sql(_LOOKUP)} FROM {staging._LINES}), l1 AS (SELECT * EXCLUDE (l_linenumber, l_orderkey) FROM l0 WHERE l_linenumber % 3 <> 1 UNION SELECT * EXCLUDE (l_linenumber, l_orderkey) REPLACE ('other' AS external_order_id) FROM l0 WHERE l_linenumber = 2 AND l_orderkey % 4 = 0),
l2 AS (SELECT * FROM l1 WHERE external_order_id IS NOT NULL AND completed_at IS NOT NULL QUALIFY count(*) OVER (PARTITION BY pallet, sku, completed_at, quantity, owner) = 1),
m AS (SELECT {staging._sql(staging.MOVEMENTS | _FILLED)} FROM {staging._LINES}), j AS (SELECT m.*, l2.order_id AS a, l2.external_order_id AS b, l2.client AS c, l2.external_client AS d FROM m LEFT JOIN l2 ON m.movement_type = 'PI' AND m.external_order_id IS NULL AND l2.pallet = m.pallet AND l2.sku = m.sku AND l2.completed_at = m.completed_at AND l2.quantity = m.quantity AND l2.owner = m.owner)
SELECT movement_type, pallet, sku, completed_at, quantity, owner, coalesce(order_id, a) AS order_id, coalesce(external_order_id, b) AS external_order_id, coalesce(client, c) AS client, coalesce(external_client, d) AS external_client, CASE WHEN b IS NOT NULL THEN 'lookup' WHEN external_order_id IS NOT NULL THEN 'source' END AS source, (b IS NOT NULL)::INT AS enriched FROM j""",
    "join_impute": f"WITH {CTES}, w AS (SELECT *, min(service_date) OVER (PARTITION BY generic_code) AS a, max(service_date) OVER (PARTITION BY generic_code) AS b FROM requests) SELECT generic_code, sku, coalesce(service_date, CASE WHEN a = b THEN a END) AS service_date, (service_date IS NULL AND a = b AND a IS NOT NULL)::INT AS imputed FROM w",
    "join_notes": f"WITH {CTES}, {_N1} SELECT external_order_id, owner, sku, quantity, note_date, service_code, service_code IS NOT NULL AS has_note FROM movements LEFT JOIN n1 ON order_code = external_order_id",
    "join_request_notes": f"WITH {CTES}, {_N2} SELECT r.generic_code, sku, requested_quantity, note_date, urgency, n2.generic_code IS NOT NULL AS has_note FROM requests r LEFT JOIN n2 ON n2.generic_code = r.generic_code",
    "join_request_items": f"WITH {CTES} SELECT generic_code, r.sku, sku_name, kilos, m3, requested_quantity * kilos AS kg, i.sku IS NOT NULL AS has_item FROM requests r LEFT JOIN (SELECT * FROM items WHERE sku::INT % 11 <> 0) i ON i.sku = r.sku",
    "join_unmatched_aligned": f"""WITH {CTES}, {_N1}, {_N2}, a AS (SELECT coalesce(external_order_id, '<NULL>') AS value, count(*) AS "left" FROM movements ANTI JOIN n1 ON order_code = external_order_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50),
b AS (SELECT coalesce(generic_code, '<NULL>') AS value, count(*) AS "right" FROM requests ANTI JOIN n2 USING (generic_code) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) SELECT value, coalesce("left", 0) AS "left", coalesce("right", 0) AS "right" FROM a FULL JOIN b USING (value)""",
    "fact_service_actuals": f"""{_LV}, {_NT}, {_SN}, {_SR}, h AS (SELECT date, deliveries_sge AS sge, deliveries_sgp AS sgp, pickups_ege AS ege, source, truth FROM sn WHERE date < DATE '{SWITCH}' UNION ALL SELECT date, deliveries_sge, deliveries_sgp, pickups_ege, source, truth FROM sr WHERE date >= DATE '{SWITCH}'), k AS (SELECT * FROM h WHERE day(date) % 9 <> 0),
w AS (SELECT min(date) FILTER (source = 'requests') AS s, min(date) AS a, max(date) AS z FROM k), g AS (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS date, s FROM w), f AS (SELECT g.date, coalesce(sge, 0)::DOUBLE AS sge, coalesce(sgp, 0)::DOUBLE AS sgp, coalesce(ege, 0)::DOUBLE AS ege, coalesce(source, CASE WHEN s IS NULL OR g.date < s THEN 'notes' ELSE 'requests' END) AS actual_source, coalesce(truth, CASE WHEN s IS NULL OR g.date < s THEN 'final' ELSE 'visible' END) AS actual_truth FROM g LEFT JOIN k USING (date))
SELECT date, kpi, actual_value, actual_source, actual_truth FROM (UNPIVOT f ON sge, sgp, ege INTO NAME kpi VALUE actual_value)""",
    "source_csv": f"WITH {CTES} SELECT operational_date, movement_type, sku::BIGINT AS sku, quantity::DOUBLE AS quantity, NULL::VARCHAR AS owner, 'owner' AS lacking FROM movements",
    "source_parquet": f"WITH {CTES} SELECT * FROM items",
    "source_top": f"WITH {CTES} SELECT sku, sku_name, kilos FROM items ORDER BY kilos DESC, sku LIMIT 500",
    "join_coverage": f"""WITH {CTES}, n AS (SELECT order_code, service_code, row_number() OVER (PARTITION BY order_code ORDER BY service_date, service_code) AS k FROM notes WHERE order_code IS NOT NULL), j AS (SELECT substr(service_code, 1, 2) AS type, service_code IS NOT NULL AS hit FROM movements LEFT JOIN n ON order_code = external_order_id AND k = 1)
SELECT 'all' AS scope, count(*) AS rows, count(*) FILTER (hit) AS matched, round(avg(hit::INT), 6) AS matched_pct FROM j UNION ALL SELECT coalesce(type, '<UNMATCHED>'), count(*), count(*) FILTER (hit), round(avg(hit::INT), 6) FROM j GROUP BY type""",
    "join_unmatched": f"WITH {CTES} SELECT generic_code, count(*) AS count FROM requests WHERE generic_code NOT IN (SELECT service_code FROM notes) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "join_best_item": "SELECT *, count(*) OVER (PARTITION BY p_name) AS rows FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_retailprice DESC, p_partkey) = 1",
    "join_open_requests": f"{_LV}, o AS (SELECT unnest(generate_series((SELECT min(created_date) FROM lv), (SELECT max(created_date) FROM lv), INTERVAL 7 DAY))::DATE AS origin) SELECT origin, date AS target_date, service_type, count(*) AS open_requests, sum(lines)::BIGINT AS open_lines, sum(units) AS open_units FROM lv JOIN o ON created_date <= origin AND origin <= date GROUP BY ALL",
    "join_as_of": "WITH r AS (SELECT l_suppkey % 5 AS kpi, l_shipdate::DATE AS target_date, l_shipdate::DATE - (l_linenumber % 4)::INT AS run_date, l_orderkey * 10 + l_linenumber AS emitted, max(l_quantity) AS value FROM lineitem GROUP BY ALL) SELECT kpi, target_date, arg_max(value, (run_date, emitted)) AS value, max(run_date) AS run_date FROM r WHERE run_date < target_date GROUP BY kpi, target_date",
    "join_key_difference": f"WITH {CTES} SELECT DISTINCT sku FROM stock WHERE sku NOT IN (SELECT sku FROM movements WHERE operational_date >= DATE '2001-06-01')",
    "join_unique_notes": f"WITH {CTES}, {_NT}, d AS (SELECT DISTINCT service_code, service_date, service_class FROM nt), w AS (SELECT date_trunc('week', service_date)::DATE AS week, count(*) FILTER (service_class = 'delivery') AS delivery, count(*) FILTER (service_class = 'pickup') AS pickup, count(*) FILTER (service_class = 'UNK') AS unclassified, count(*) AS total FROM d GROUP BY 1) SELECT *, row_number() OVER (ORDER BY week)::INT AS ordinal FROM w",
    "fact_requests": f"{_LV} SELECT * FROM lv",
    "fact_services_notes": f"WITH {CTES}, {_NT}, {_SN} SELECT * FROM sn",
    "fact_services_requests": f"{_LV}, {_SR} SELECT * FROM sr",
    "fact_services_hybrid": f"{_LV}, {_NT}, {_SN}, {_SR}, {_HY} SELECT * FROM hy",
    "fact_freshness": f"{_LV}, {_NT}, {_SN}, {_SR}, {_HY} SELECT 'last_notes' AS metric, max(date)::VARCHAR AS value FROM sn UNION ALL SELECT 'last_requests', max(date)::VARCHAR FROM sr UNION ALL SELECT 'last_hybrid', max(date)::VARCHAR FROM hy UNION ALL SELECT 'days_from_' || source, count(*)::VARCHAR FROM hy GROUP BY source UNION ALL SELECT 'overlap_days', count(*)::VARCHAR FROM (SELECT date FROM sn WHERE date >= DATE '{SWITCH}' INTERSECT SELECT date FROM sr WHERE date >= DATE '{SWITCH}')",
    "fact_picking": f"WITH {CTES}, {_PK} SELECT * FROM pk",
    "fact_other_movements": f"WITH {CTES} SELECT operational_date AS date, count(*) FILTER (movement_type = 'CR') AS CR, count(*) FILTER (movement_type = 'EP') AS EP FROM movements WHERE movement_type IN ('CR', 'EP') GROUP BY 1",
    "fact_backlog": f"{_LV} SELECT date, service_type, service_class, count(*) AS requests, sum(lines)::BIGINT AS lines, sum(items)::BIGINT AS items, sum(units) AS units, sum(kg) AS kg, sum(m3) AS m3 FROM lv GROUP BY ALL",
    "fact_backlog_horizon": f"{_LV} SELECT (date - h::INT)::DATE AS snapshot, h::INT AS horizon, service_type, count(*) AS requests FROM lv, range(1, 29) AS t(h) GROUP BY ALL",
    "fact_weekly": f"WITH {CTES}, {_PK} {_WEEKLY}",
    "fact_actuals_daily": f"WITH {CTES}, {_ACT} SELECT date, kpi, actual_value, 'notes' AS actual_source, 'final' AS actual_truth FROM al WHERE kpi <> 'items'",
    "fact_actuals_weekly": f"WITH {CTES}, {_ACT}, s AS (SELECT *, CASE WHEN date >= DATE '{SWITCH}' THEN 'requests' ELSE 'notes' END AS src FROM al WHERE kpi <> 'items') SELECT date_trunc('week', date)::DATE AS week, kpi, sum(actual_value) AS actual_value, CASE WHEN min(src) = max(src) THEN min(src) ELSE 'mixed' END AS actual_source, 'final' AS actual_truth FROM s GROUP BY 1, 2",
    "fact_kpi_cards": f"WITH {CTES}, {_ACT}, j AS (SELECT CASE WHEN kpi IN ('lines', 'items') THEN 'picking' ELSE kpi END AS g, CASE WHEN kpi <> 'items' THEN actual_value END AS a, actual_value + 1 AS f FROM al WHERE year(date) = 1999 AND quarter(date) = 2) SELECT g AS \"group\", sum(a) AS actual, sum(f) AS forecast, coalesce(sum(a), sum(f)) AS headline, round((sum(a) - sum(f)) / sum(f), 6) AS delta_pct FROM j GROUP BY g",
    "calendar_days": f"WITH {_CAL} SELECT cal.*, orders FROM cal JOIN (SELECT o_orderdate::DATE AS date, count(*) AS orders FROM orders GROUP BY 1) USING (date)",
    "calendar_weeks": f"WITH {_CAL}, w AS (SELECT date_trunc('week', date)::DATE AS week, arg_min(month, date) AS month, arg_min(iso_week, date) AS iso_week, max(holiday) AS any_holiday, sum(holiday)::BIGINT AS holidays, sum(bridge)::BIGINT AS bridges, max(easter_week) AS easter_week, round(avg(weekend), 6) AS weekend_share FROM cal GROUP BY 1) SELECT w.*, orders FROM w JOIN (SELECT date_trunc('week', o_orderdate)::DATE AS week, count(*) AS orders FROM orders GROUP BY 1) USING (week)",
    "series_features": f"""WITH s AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS date, count(*)::DOUBLE AS target FROM orders GROUP BY ALL), b AS (SELECT series, min(date) AS a, max(date) AS z FROM s GROUP BY 1), g AS (SELECT series, unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY))::DATE AS date, a, z FROM b),
f AS (SELECT g.series, g.date, coalesce(target, 0) AS target, g.date BETWEEN a AND z AS is_actual, 'normal' AS regime FROM g LEFT JOIN s USING (series, date))
SELECT *, lag(target, 7) OVER o AS lag_7, lag(target, 14) OVER o AS lag_14, lag(target, 28) OVER o AS lag_28, {', '.join(f"round(avg(target) OVER {_FR(w)}, 6) AS mean_{w}, quantile_cont(target, 0.5) OVER {_FR(w)} AS median_{w}" for w in (7, 14, 28))},
round(avg(target) OVER (PARTITION BY series, isodow(date) ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS mean_same_weekday FROM f WINDOW o AS (PARTITION BY series ORDER BY date)""",
    "series_labels": f"""WITH s AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS date, count(*)::DOUBLE AS target FROM orders GROUP BY ALL), b AS (SELECT series, min(date) AS a, max(date) AS z, CASE WHEN series <> '5-LOW' THEN min(date) FILTER (date >= DATE '{SWITCH}') END AS w FROM s GROUP BY 1),
g AS (SELECT series, unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY))::DATE AS date, a, z, w FROM b) SELECT g.series, g.date, coalesce(target, 0) AS target, g.date BETWEEN a AND z AS is_actual, 'normal' AS regime, CASE WHEN w IS NULL OR g.date < w THEN 'notes' ELSE 'requests' END AS source,
CASE WHEN w IS NULL OR g.date < w THEN 'final' ELSE 'visible' END AS truth, (w IS NULL OR g.date < w)::INT AS is_final FROM g LEFT JOIN s USING (series, date)""",
    "series_offsets": f"""{_LV}, a AS (SELECT regexp_extract(generic_code, '([0-9]+)$', 1) AS code, service_type, date AS service_date FROM lv), p AS (SELECT external_order_id AS code, operational_date AS pick_date, quantity FROM movements WHERE movement_type = 'PI' AND external_order_id IS NOT NULL)
SELECT service_type, (service_date - pick_date)::INT AS "offset", count(*) AS lines, sum(quantity) AS units FROM a JOIN p USING (code) WHERE service_date - pick_date BETWEEN 0 AND 30 GROUP BY ALL""",
    "quality_prefixes": f"WITH {CTES} SELECT coalesce(nullif(regexp_extract(upper(generic_code), '^[A-Z]+'), ''), 'OTHER') AS prefix, count(*) AS count FROM requests GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "normalize_lookup": """WITH l AS (SELECT l_orderkey, l_linenumber, 'P' || l_suppkey AS pallet, l_partkey::VARCHAR AS sku, date_trunc('minute', l_shipdate)::TIMESTAMP AS completed_at, l_quantity::DOUBLE AS quantity, 'C' || (o_custkey % 50) AS owner, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT pallet, sku, completed_at, quantity, owner, min(l_orderkey) AS o, min('K' || o_custkey) AS c FROM l WHERE l_orderkey % 10 <> 7 GROUP BY ALL HAVING count(DISTINCT (l_orderkey, o_custkey)) = 1),
j AS (SELECT l.*, CASE WHEN l_linenumber = 3 THEN 'CR' ELSE 'PI' END AS movement_type, CASE WHEN l_linenumber = 2 THEN 'OWN' END AS own, o, c FROM l LEFT JOIN k ON l_linenumber NOT IN (2, 3) AND k.pallet = l.pallet AND k.sku = l.sku AND k.completed_at = l.completed_at AND k.quantity = l.quantity AND k.owner = l.owner)
SELECT movement_type, pallet, sku, completed_at, quantity, owner, o::VARCHAR AS order_id, coalesce(own, 'E' || o) AS external_order_id, CASE WHEN o IS NOT NULL THEN c END AS client, NULL::VARCHAR AS external_client, CASE WHEN o IS NOT NULL THEN 'lookup' WHEN own IS NOT NULL THEN 'source' END AS external_order_id_source,
(o IS NOT NULL)::INT AS external_order_id_enriched, coalesce(own, 'E' || o) || '|' || owner AS transaction_id FROM j""",
    "normalize_movements": """WITH m AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'CR' ELSE 'PI' END AS movement_type, o_orderdate::TIMESTAMP AS started_at, CASE WHEN l_linenumber % 7 <> 0 THEN date_trunc('day', l_shipdate)::TIMESTAMP END AS completed_at, l_partkey, l_quantity::DOUBLE AS quantity, 'C' || (o_custkey % 50) AS owner,
 CASE WHEN l_suppkey % 10 <> 0 THEN l_orderkey::VARCHAR END AS external_order_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT movement_type, started_at, completed_at, coalesce(completed_at, started_at)::DATE AS operational_date, (completed_at IS NULL)::INT AS date_fallback, (epoch(completed_at) - epoch(started_at))::BIGINT AS duration_seconds, l_partkey::VARCHAR AS sku, 'ITEM ' || l_partkey AS sku_description, quantity, owner, external_order_id,
 CASE WHEN external_order_id IS NOT NULL THEN 'source' END AS external_order_id_source, 0 AS external_order_id_enriched, external_order_id || '|' || owner AS transaction_id FROM m""",
    "normalize_requests": """WITH r AS (SELECT 'SGE' || o_orderkey AS generic_code, CASE WHEN l_suppkey % 4 <> 0 THEN o_orderdate::DATE + (o_orderkey % 2 * (l_linenumber % 3))::INT END AS d, o_orderdate::TIMESTAMP AS created_at, l_partkey::VARCHAR AS sku, CASE l_linenumber % 3 WHEN 0 THEN 'ENVIO' WHEN 1 THEN 'RECOGIDA' END AS action FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
w AS (SELECT *, min(d) OVER (PARTITION BY generic_code) AS a, max(d) OVER (PARTITION BY generic_code) AS b FROM r)
SELECT generic_code, coalesce(d, CASE WHEN a = b THEN a END) AS service_date, (d IS NULL AND a IS NOT NULL AND a = b)::INT AS service_date_imputed_from_request, created_at, sku, action, CASE action WHEN 'ENVIO' THEN 'delivery' WHEN 'RECOGIDA' THEN 'pickup' END AS service_flow, NULL::DOUBLE AS requested_quantity FROM w""",
    "normalize_items": "SELECT p_partkey::VARCHAR AS sku, upper(p_name) AS sku_name, p_size::DOUBLE AS weight_kg, NULL::DOUBLE AS m2 FROM part",
    "normalize_notes": "SELECT 'SGP' || o_orderkey AS service_code, 'SGP' || o_orderkey AS description, o_orderdate::DATE AS service_date, o_orderstatus AS urgency, o_custkey + 0.5::DOUBLE AS volume_m3, NULL::DOUBLE AS weight_kg FROM orders",
    "normalize_stock": f"SELECT DATE '{staging.SNAPSHOT}' AS snapshot_date, l_suppkey::VARCHAR AS owner_code, l_partkey::VARCHAR AS sku, l_quantity::DOUBLE AS stock_quantity, 'S' || l_suppkey AS location, NULL::VARCHAR AS occupancy_status FROM lineitem WHERE l_linenumber <> 1",
}

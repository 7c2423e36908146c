"""Raw exports with odd headers, values and repeats."""

from datetime import date, datetime

from pyspark.sql import functions as F

from depotlane.functions import text as t
from depotlane.operators import basket, enrich, nowcast, quality
from depotlane.sources import normalize


def test_movements_with_lookup(spark):
    raw = spark.createDataFrame([("PI", "01/02/2024 10:00:00", "x", "022043", "5", "C1", None), ("pi", "01/02/2024", "02/02/2024 00:00:10", "9", "n", "C1", "K.0")], "`Tipo movimiento` string, `Fecha inicio` string, `Fecha finalización` string, `Artículo` string, Cantidad string, Propietario string, `Pedido externo` string")
    raw = raw.withColumn("Paleta", F.lit("p1"))
    key = ("P1", "22043", datetime(2024, 2, 1, 10, 5), 5.0, "C1")
    raw = raw.withColumn("Fecha finalización", F.when(F.col("Artículo") == "022043", "01/02/2024 10:05:00").otherwise(F.col("Fecha finalización")))
    columns = "paleta string, articulo string, `Fecha finalizacion` timestamp, cantidad double, propietario string, pedido string, `Pedido externo` string, cliente string, `Cliente externo` string"
    rows = [(*key, "12345", "SGE202205972", "C001", None), (*key, "12345", "SGE202205972", "C001", None), (*key, "12345", None, "C001", None)]
    lookup = spark.createDataFrame(rows, columns).withColumn("Fecha finalizacion", F.date_format("Fecha finalizacion", "dd/MM/yyyy HH:mm:ss"))
    assert normalize.order_lookup(lookup).count() == 1
    a, b = sorted(normalize.movements(raw, normalize.order_lookup(lookup)).collect(), key=lambda r: r.sku)
    assert (a.sku, a.external_order_id, a.external_order_id_source, a.external_order_id_enriched, a.operational_date, a.date_fallback, a.duration_seconds) == ("22043", "SGE202205972", "lookup", 1, date(2024, 2, 1), 0, 300)
    assert (a.order_id, a.client, a.external_client) == ("12345", "C001", None)
    assert (b.movement_type, b.external_order_id, b.external_order_id_source, b.operational_date, b.date_fallback, b.duration_seconds, b.quantity) == ("PI", "K", "source", date(2024, 2, 2), 0, 86410, None)
    other = lookup.unionByName(lookup.withColumn("Pedido externo", F.lit("other")))
    assert [r.external_order_id for r in normalize.movements(raw, normalize.order_lookup(other)).orderBy("sku").collect()] == [None, "K"]  # the key is ambiguous
    assert enrich.fill_orders(normalize.movements(raw).drop("enriched", "source"), normalize.columns(other, normalize.LOOKUP)).count() == 2  # nor does it multiply movements
    assert a.transaction_id == "SGE202205972|C1"
    assert normalize.movements(raw.limit(0)).count() == 0
    assert normalize.movements(raw.select("Cantidad")).first().external_order_id_source is None


def test_request_lines(spark):
    raw = spark.createDataFrame([("SGE1", "13/05/2026", "ENVIO"), ("SGE1", None, "recogida"), ("SGE2", "01/01/2026", None), ("SGE2", "02/01/2026", None), ("SGE2", None, "otro")], "`Codigo Generico` string, `Fecha de servicio` string, Accion string")
    got = sorted((r.generic_code, str(r.service_date), r.service_date_imputed_from_request, str(r.service_flow)) for r in normalize.request_lines(raw).collect())
    assert got == [("SGE1", "2026-05-13", 0, "delivery"), ("SGE1", "2026-05-13", 1, "pickup"), ("SGE2", "2026-01-01", 0, "None"), ("SGE2", "2026-01-02", 0, "None"), ("SGE2", "None", 0, "None")]


def test_items_notes_stock(spark):
    raw = spark.createDataFrame([("01", "b", "1"), ("1", "a", "2"), (None, "c", "3")], "`Código` string, Nombre string, Kilos string")
    assert [(r.sku, r.sku_name, r.weight_kg, r.m3) for r in normalize.items(raw).collect()] == [("1", "A", 2.0, None)]
    twice = spark.createDataFrame([("x", "SGP1")], "descripcion string, `Descripción` string")
    assert [(r.service_code, r.description) for r in normalize.notes(twice).collect()] == [("X", "X")]
    assert normalize.stock(spark.createDataFrame([("1",), ("",)], "`Art.Y` string"), "2001-06-30").collect()[0].snapshot_date == date(2001, 6, 30)


def test_operational_and_prefixes(spark):
    rows = spark.createDataFrame([(None, None), (datetime(2024, 1, 1, 5), None)], "a timestamp, b timestamp").select(t.operational("a", "b").alias("d")).select("d.*").collect()
    assert [tuple(r) for r in rows] == [(None, 0, None), (date(2024, 1, 1), 1, None)]
    codes = spark.createDataFrame([("sg1",), ("SG2",), ("7",), (None,), ("",)], "c string")
    assert {(r.prefix, r["count"]) for r in quality.prefix_frequencies(codes, "c").collect()} == {("OTHER", 3), ("SG", 2)}


def test_open_sums_and_history_pairs(spark):
    r = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 9), "A", 2), (date(2024, 1, 8), date(2024, 1, 9), "A", 3)], "c date, d date, k string, lines int")
    o = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 8),)], "origin date")
    assert sorted((str(x.origin), x.open_requests, x.open_lines) for x in enrich.open_at(r, o, "c", "d", ["k"], ["lines"]).collect()) == [("2024-01-01", 1, 2), ("2024-01-08", 2, 5)]
    items = spark.createDataFrame([(t_, a, 1.0, datetime(2024, m, 1)) for t_, a, m in (("t1", "x", 1), ("t1", "y", 1), ("t2", "x", 5), ("t2", "y", 5), ("t3", "x", 5))], "transaction_id string, article string, quantity_sum double, last_completion_date timestamp")
    plain, again = basket.pair_metrics(items, 1), basket.pairs_of_history(basket.temporal_pairs(items), 1)
    assert sorted(plain.columns) == sorted(again.columns)
    assert [tuple(x) for x in plain.select(*sorted(plain.columns)).collect()] == [tuple(x) for x in again.select(*sorted(plain.columns)).collect()]


def test_transformer_by_urgency(spark):
    matched = spark.createDataFrame([("A", "SI", "1", 0, 4.0), ("A", "SI", "1", 1, 4.0), ("A", "NO", "2", 0, 1.0)], "service_type string, urgency string, code string, offset int, quantity double")
    services = spark.createDataFrame([("A", "SI"), ("A", "NO"), ("A", "NO"), ("A", "NO"), ("B", "SI")], "service_type string, urgency string")
    forecast = spark.createDataFrame([(date(2024, 1, 10), "A", 8.0), (date(2024, 1, 10), "B", 8.0)], "date date, service_type string, forecast double")
    got = {str(r.pick_date): (r.service_type, r.lines, r.units) for r in nowcast.apply_transformer(forecast, nowcast.fit_transformer(matched, services)).collect()}
    assert got == {"2024-01-10": ("A", 8 * 0.25 * 2 * 0.5 + 8 * 0.75 * 1, 8 * 0.25 * 8 * 0.5 + 8 * 0.75 * 1), "2024-01-09": ("A", 2.0, 8.0)}


def test_lookup_reads_and_shuffles_once(spark):
    movements = spark.createDataFrame([("PI", "1", "C1", None), ("PI", "1", "C1", "K"), ("PI", None, "C1", None), (None, "1", "C1", None), ("PI", "2", "C1", None), ("PI", "3", "C1", None), ("CR", "1", "C1", None)] * 2, "movement_type string, sku string, owner string, external_order_id string")
    lookup = spark.createDataFrame([("1", "C1", "A", None), ("1", "C1", "A", None), ("1", "C1", None, "x"), ("2", "C1", "A", "x"), ("2", "C1", "A", None), (None, "C1", "B", None)], "sku string, owner string, external_order_id string, client string")
    out = enrich.fill_orders(movements.withColumn("client", F.when(F.col("sku") == "3", "own")), lookup, ["sku", "owner"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = sorted(str((r.movement_type, r.sku, r.external_order_id, r.client, r.enriched, r.source)) for r in out.collect())
    wanted = [("PI", "1", "A", None, 1, "lookup"), ("PI", "1", "K", None, 0, "source"), ("PI", None, None, None, 0, None), (None, "1", None, None, 0, None), ("PI", "2", None, None, 0, None), ("PI", "3", None, "own", 0, None), ("CR", "1", None, None, 0, None)]
    assert got == sorted(str(r) for r in wanted * 2)

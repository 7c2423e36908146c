"""Text, dates and classes on hand-made rows."""

from datetime import date

from pyspark.sql import functions as F

from depotlane.functions import text as t
from depotlane.operators import enrich, facts, quality


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def test_text(spark):
    assert values(spark, ["  Ñandú  café ", "straße", None], t.normalize_text) == ["NANDU CAFE", "STRASSE", None]
    assert values(spark, ["022043", "123.0", "000", " ab 1 ", "", None], t.normalize_code) == ["22043", "123", "0", "AB 1", None, None]
    assert values(spark, ["nan", " x  y ", "<NA>"], t.clean_string) == [None, "x y", None]
    assert values(spark, ["-12.00", "1.5", "None"], t.canonical_identifier) == ["-12", "1.5", None]
    assert values(spark, ["1.5", "x", None], t.number) == [1.5, None, None]


def test_dates(spark):
    got = values(spark, ["01/04/2026 13:00:00", "06/11/2025", "2024-02-03", "31/02/2020", "x", None], lambda c: F.to_date(t.day_first(c)))
    assert got == [date(2026, 4, 1), date(2025, 11, 6), date(2024, 2, 3), None, None, None]
    rows = spark.createDataFrame([(2024,), (2025,), (2000,), (1961,)], "y int").select(t.easter(F.col("y"))).collect()
    assert [r[0] for r in rows] == [date(2024, 3, 31), date(2025, 4, 20), date(2000, 4, 23), date(1961, 4, 2)]
    one = spark.createDataFrame([(date(2024, 2, 29),)], "d date").select(t.same_day_in(F.col("d"), 2023), t.monday_of_iso(F.lit(2024), F.lit(53)), t.monday_of_iso(F.lit(2020), F.lit(53))).first()
    assert tuple(one) == (date(2023, 2, 28), None, date(2020, 12, 28))


def test_service_classes(spark):
    rows = [("SG06202625794", "ENVIO"), ("EG22202625747", "RECOGIDA"), ("DEGE202523889", "RECOGIDA"), ("SGP202624836", None), ("X1", None)]
    df = spark.createDataFrame([(*r, "PORTE ENVIO MATERIAL") for r in rows], "code string, action string, concept string")
    got = df.select(t.service_class(F.col("code"), F.col("action"), F.col("concept")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [("SGE", "delivery", "prefix and action"), ("EGE", "pickup", "prefix and action"), ("EGE", "pickup", "prefix and action"), ("SGP", "delivery", "prefix"), ("UNK", "delivery", "concept")]


def test_target_dates_and_imputation(spark):
    rows = [("EGE202600001", None, None, None, date(2026, 4, 3)), ("SGE1", None, date(2026, 5, 13), date(2026, 1, 1), None), ("SGE1", None, None, None, None)]
    df = spark.createDataFrame([(*r, None, "1", 1.0, date(2026, 1, 1), None) for r in rows], "generic_code string, action string, service_date date, event_start date, event_end date, concept string, sku string, requested_quantity double, created_date date, modified_at timestamp")
    got = {(r.generic_code, r.field, r.date, r.missing) for r in facts.prepare_requests(df).collect()}
    assert got == {("EGE202600001", "event_end", date(2026, 4, 3), False), ("SGE1", "service_date", date(2026, 5, 13), False), ("SGE1", "<MISSING>", None, True)}
    filled = enrich.impute_single(df, "generic_code", "service_date").where("imputed = 1").collect()
    assert [(r.generic_code, r.service_date) for r in filled] == [("SGE1", date(2026, 5, 13))]


def test_lookup_and_quality(spark):
    m = spark.createDataFrame([("PI", "22043", "C1", None), ("PI", "9", "C1", None), ("CR", "22043", "C1", None), ("PI", "22043", "C1", "K")], "movement_type string, sku string, owner string, external_order_id string")
    lookup = spark.createDataFrame([("C1", "22043", "SGE202205972"), ("C1", "9", "A"), ("C1", "9", "B"), (None, "9", "Z")], "owner string, sku string, external_order_id string")
    got = sorted((r.movement_type, r.sku, str(r.external_order_id), r.enriched, str(r.source)) for r in enrich.fill_orders(m, enrich.unambiguous(lookup, ["owner", "sku"], ["external_order_id"]), ["owner", "sku"]).collect())
    assert got == [("CR", "22043", "None", 0, "None"), ("PI", "22043", "K", 0, "source"), ("PI", "22043", "SGE202205972", 1, "lookup"), ("PI", "9", "None", 0, "None")]
    profile = {r.column: r.nulls for r in quality.null_profile(m).collect()}
    assert profile == {"movement_type": 0, "sku": 0, "owner": 0, "external_order_id": 3}
    assert quality.null_profile(m.limit(0)).count() == 4

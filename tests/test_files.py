"""Sources and sinks round trip."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from depotlane.operators import tracking
from depotlane.sources import files


def test_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("1", "2,5x"), ("2", "3.5")], "`Código  SKU` string, Cantidad string")
    df, renames, missing = files.canonical_columns(raw, {"sku": ["codigo sku"], "quantity": ["cantidad"], "owner": []})
    assert df.columns == ["sku", "quantity"] and missing == ["owner"] and len(renames) == 2
    schema = StructType([StructField("owner", StringType()), StructField("quantity", DoubleType()), StructField("sku", StringType())])
    out = files.project(df, schema)
    files.write_table(out, f"{tmp_path}/t", csv=True)
    assert sorted(r.quantity or 0 for r in files.read_table(spark, f"{tmp_path}/t.parquet").collect()) == [0, 3.5]
    assert files.read_table(spark, f"{tmp_path}/t.csv").count() == 2
    files.write_top(out, f"{tmp_path}/top", [F.col("sku").desc()], 1)
    assert [r.sku for r in spark.read.json(f"{tmp_path}/top").collect()] == ["2"]
    with pytest.raises(ValueError):
        files.canonical_columns(raw, {"sku": ["codigo sku", "cantidad"]})


def test_latest_snapshot(spark, tmp_path):
    for day, n in (("01-05-2026", 2), ("10-06-2026", 3)):
        spark.range(n).selectExpr("cast(id as string) as sku").toPandas().to_csv(f"{tmp_path}/stock {day}.csv", index=False)
    got = files.latest_snapshot(spark, f"{tmp_path}/*.csv")
    assert got.count() == 3 and got.first().snapshot_date == date(2026, 6, 10)


def test_history(spark):
    old = spark.createDataFrame([("r1", date(2026, 1, 1), "k", "m", "s", "daily", 1.0, "2026-01-01 06:00:00")], "run_id string, target_date date, kpi string, model string, source string, frequency string, forecast_value double, run_ts string").withColumn("run_ts", F.to_timestamp("run_ts"))
    new = old.withColumn("forecast_value", F.lit(2.0)).withColumn("extra", F.lit("x"))
    got = tracking.append_history(old, new).collect()
    assert len(got) == 1 and got[0].forecast_value == 2.0 and got[0].extra == "x"
    a, b = files.split_history(old, ["s"])
    assert (a.count(), b.count()) == (1, 0)

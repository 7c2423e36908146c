"""The domain tables, made from the test tables by the same expressions in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Snapshot date of the staged stock, and the date on which staged jobs "run".
SNAPSHOT = "2001-06-30"

MOVEMENTS = {
    "movement_type": "CASE WHEN l_returnflag = 'R' THEN 'CR' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'EP' ELSE 'PI' END",
    "sku": "CAST(l_partkey AS STRING)",
    "sku_description": "'ITEM ' || CAST(l_partkey AS STRING)",
    "owner": "'C' || CAST(o_custkey % 50 AS STRING)",
    "external_order_id": "CASE WHEN l_suppkey % 10 <> 0 THEN CAST(l_orderkey AS STRING) END",
    "location": "CASE WHEN l_suppkey % 13 <> 0 THEN 'L' || CAST(l_suppkey % 20 AS STRING) END",
    "pallet": "'P' || CAST(l_suppkey AS STRING)",
    "started_at": "l_shipdate",
    "completed_at": "CASE WHEN l_linenumber % 7 <> 0 THEN l_shipdate END",
    "operational_date": "CAST(l_shipdate AS DATE)",
    "quantity": "CASE WHEN l_linenumber % 11 = 10 THEN 0.0 ELSE l_quantity END",
}
REQUESTS = {
    "generic_code": "CASE o_orderpriority WHEN '1-URGENT' THEN 'SGP' WHEN '2-HIGH' THEN 'SGE' WHEN '3-MEDIUM' THEN 'SG' WHEN '4-NOT SPECIFIED' THEN 'EGE' ELSE 'XX' END || CAST(o_orderkey AS STRING)",
    "action": "CASE WHEN l_linenumber % 5 = 0 THEN 'RECOGIDA' WHEN l_linenumber % 5 = 1 THEN 'ENVIO' END",
    "concept": "CASE WHEN o_orderkey % 3 = 0 THEN 'PORTE RECOGIDA MATERIAL' WHEN o_orderkey % 3 = 1 THEN 'PORTE ENVIO' ELSE 'OTRO' END",
    "sku": "CAST(l_partkey AS STRING)",
    "requested_quantity": "l_quantity",
    "created_date": "CAST(o_orderdate AS DATE)",
    "service_date": "CASE WHEN l_suppkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(l_linenumber % 3 + 1 AS INT) END",
    "event_start": "CASE WHEN l_suppkey % 8 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(2 AS INT) END",
    "event_end": "CAST(o_orderdate AS DATE) + CAST(l_linenumber % 4 + 3 AS INT)",
    "modified_at": "l_shipdate",
    "line_modified_at": "CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate + INTERVAL 2 DAY END",
    "order_created_at": "o_orderdate",
    "request_created_at": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 90 DAY END",
}
NOTES = {
    "service_code": "CASE o_orderpriority WHEN '1-URGENT' THEN 'SGP' WHEN '2-HIGH' THEN 'SGE' WHEN '4-NOT SPECIFIED' THEN 'EGE' ELSE 'ZZ' END || CAST(o_orderkey AS STRING)",
    "order_code": "CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey AS STRING) END",
    "service_date": "CAST(o_orderdate AS DATE)",
    "action": "CASE WHEN o_orderkey % 7 = 0 THEN 'RECOGIDA' WHEN o_orderkey % 7 = 1 THEN 'ENTREGA' END",
    "concept": "CASE WHEN o_orderkey % 4 = 0 THEN 'DEVOLUCION' WHEN o_orderkey % 4 = 1 THEN 'EXPEDICION' ELSE 'OTRO' END",
    "urgency": "CASE o_orderstatus WHEN 'F' THEN 'N' WHEN 'O' THEN 'SI' WHEN 'P' THEN 'MUY URGENTE' END",
    "weight_kg": "CASE WHEN o_custkey % 6 <> 0 THEN CAST(o_custkey % 400 AS DOUBLE) END",
    "volume_m3": "CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 7 AS DOUBLE) / 4 END",
}
ITEMS = {"sku": "CAST(p_partkey AS STRING)", "sku_name": "p_name", "category": "p_type", "kilos": "CAST(p_size AS DOUBLE)", "m3": "p_size / 128.0E0"}
STOCK = {"owner": "'C' || CAST(l_suppkey % 50 AS STRING)", "sku": "CAST(l_partkey AS STRING)", "location": "'S' || CAST(l_suppkey % 20 AS STRING)", "sku_description": "'ITEM ' || CAST(l_partkey AS STRING)"}


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
#: Common table expressions for DuckDB: put after WITH.
CTES = f"""movements AS (SELECT {_sql(MOVEMENTS)} FROM {_LINES}),
requests AS (SELECT {_sql(REQUESTS)} FROM {_LINES}),
notes AS (SELECT {_sql(NOTES)} FROM orders),
items AS (SELECT {_sql(ITEMS)} FROM part),
stock AS (SELECT {_sql(STOCK)}, DATE '{SNAPSHOT}' AS snapshot_date, sum(l_quantity) AS stock_quantity FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_lines(spark, sf_dir), MOVEMENTS)


def picks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Movements with every line as a pick, for baskets; more: columns of order lines that ride along."""
    return _select(_lines(spark, sf_dir), MOVEMENTS | {"movement_type": "'PI'"} | {c: c for c in more})


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_lines(spark, sf_dir), REQUESTS)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_read(spark, sf_dir, "orders"), NOTES)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_read(spark, sf_dir, "part"), ITEMS)


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    keys = _select(lines, STOCK | {"l_quantity": "l_quantity"})
    out = keys.groupBy(*STOCK).agg(F.sum("l_quantity").alias("stock_quantity"))
    return out.withColumn("snapshot_date", F.lit(SNAPSHOT).cast("date"))

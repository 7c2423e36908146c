"""Reading raw exports and writing results."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder (all columns as text) or Parquet, by the path's ending."""
    if path.lower().endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=False)
    return spark.read.parquet(path)


def latest_snapshot(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of the files whose name holds the newest dd-mm-yyyy date, with snapshot_date; no rows if none holds one.

    The date is chosen from a listing of names, so older files are never opened. That listing is all the driver sees.
    """
    names = spark.read.format("binaryFile").load(pattern).select("path")  # of a path alone, no content is read
    day = F.try_to_timestamp(F.nullif(F.regexp_extract(F.element_at(F.split("path", "/"), -1), "([0-9]{2}-[0-9]{2}-[0-9]{4})", 1), F.lit("")), F.lit("dd-MM-yyyy"))
    found = names.select("path", F.to_date(day).alias("day")).collect()
    newest = max((r.day for r in found if r.day), default=None)
    paths = [r.path for r in found if newest and r.day == newest]
    rows = spark.read.csv(paths or pattern, header=True, inferSchema=False)
    return (rows if paths else rows.limit(0)).withColumn("snapshot_date", F.lit(newest).cast("date"))


def header(name: str) -> str:
    """A header in lower case, without accents, in single spaces."""
    plain = unicodedata.normalize("NFKD", str(name)).encode("ascii", "ignore").decode()
    return " ".join(plain.strip().lower().split())


def canonical_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> tuple[DataFrame, dict[str, str], list[str]]:
    """The table with known headers renamed, the renames, and the wanted columns it lacks; headers that meet are refused."""
    wanted = {header(a): name for name, others in aliases.items() for a in (name, *others)}
    names = [wanted.get(header(c), c) for c in df.columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"several columns become {', '.join(twice)}")
    renames = {c: n for c, n in zip(df.columns, names, strict=True) if c != n}
    return df.toDF(*names), renames, [n for n in aliases if n not in names]


def project(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a schema in its order and types; missing ones are null, values that don't fit are null."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet, and CSV beside it if asked for."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    if csv:
        df.write.mode("overwrite").csv(f"{path}.csv", header=True)


def write_top(df: DataFrame, path: str, order: Sequence, n: int = 5000) -> None:
    """The first n rows in an order, as JSON lines in one file."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").json(path)  # bounded by n


def split_history(history: DataFrame, official: Sequence[str], source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows of official sources, and the rest."""
    known = F.coalesce(F.col(source).isin(*official), F.lit(False))
    return history.where(known), history.where(~known)

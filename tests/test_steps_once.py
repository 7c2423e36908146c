"""Steps that several parts of a query share, and counts and dates that are taken a cheaper way."""

from pyspark.sql import functions as F

from depotlane.functions import text as t
from depotlane.operators import abc


def test_firsts_are_distinct_counts(spark):
    rows = [("s", "a", 1), ("s", "a", 2), ("s", None, 2), ("u", None, None), (None, "a", 1), (None, "b", 1)]
    df = spark.createDataFrame(rows, "sku string, place string, day int")
    made = abc.with_firsts(df, ["sku"], ["place", "day"]).groupBy("sku").agg(F.sum("new_place"), F.sum("new_day"))
    wanted = df.groupBy("sku").agg(F.countDistinct("place"), F.countDistinct("day"))
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)


def test_guarded_formats_read_the_same(spark):
    odd = ["1/2/2001", " 31/12/1999 7:05 ", "1/2/2001 07:05:09", "1-2-2001", "2001-02-01", "2001-02-01 10:11:12", "31/02/1999", "none", "", None, "1/2/01", "+1/2/2001", "1/2/+2001", "1/2/2001x", "2001-2-1", "1/2/12001", "١/2/2001", "1/2/2001 7:5"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("x"), F.lit(f)) for f in t.FORMATS])
    rows = df.select("x", t.day_first(F.col("x")).alias("made"), plain.alias("wanted"), t.to_ascii(F.col("x")).alias("ascii")).collect()
    assert all(r.made == r.wanted for r in rows) and sum(r.made is not None for r in rows) >= 6
    made = spark.createDataFrame([("ñaß é",), ("plain",), (None,)], "x string").select(t.to_ascii(F.col("x"))).collect()
    assert [r[0] for r in made] == ["naSS e", "plain", None]

"""Compression classifier: held-out accuracy and odd rows."""

import os

import pytest
from pyspark.sql import functions as F

from depotlane.llm import quality as q

DIR = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_held_out_accuracy(spark):
    got = q.op1_quality(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").where("held_out")
    row = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.avg("score").alias("mean"), F.avg("quality").alias("good")).first()
    assert row.right > 0.93 and abs(row.mean - row.good) < 0.05


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "plain words here", 5.0), (2, None, 1.0), (3, "", 1.0), (None, "x" * 100000, 2.0), (1, "plain words here", 0.0)], "doc_id long, text string, y double")
    labels = spark.createDataFrame([(1, 1), (1, None), (77, 0), (None, 0)], "doc_id long, quality int")
    got = q.fit(docs, labels)(docs).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert q.fit(docs, labels.limit(0))(docs.limit(0)).count() == 0
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, (f"good prose number {i} runs on " if i % 3 else f"BUY!! {i} NOW!! ") * 5) for i in range(400)] + [(500, None), (501, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in q.fit(docs, labels)(docs).collect()}
    assert got[3] < 0.5 < got[4] and 0 <= got[500] == got[501] <= 1

"""Cutting lineage, and writing what is read again, where every executor can see it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    It is the one that the session names in spark.checkpoint.dir. A cluster without one has
    nowhere to write that they all see, so this fails there; in local mode, as in tests, where
    driver and executors are one process, a folder of that process is set.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="depotlane-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df`, written once to the checkpoint folder, so that no lost executor costs the work before it."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A path in the checkpoint folder that nothing has used."""
    return f"{_shared(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df`, written once as Parquet to the checkpoint folder: several readers each take the columns they need."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

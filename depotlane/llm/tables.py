"""Reading tables, and small helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depotlane.lineage import cut

__all__ = ["SPACE", "cut", "read", "same", "slices", "text_of"]

#: White space between words: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes each in a column of strings, so that a worker holds few at once."""
    sizes = np.fromiter((len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)), np.int64, batch.num_rows)
    part = (np.cumsum(sizes) - sizes) // size
    ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(ends, ends[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def same(left: Column, right: Column) -> Column:
    """Equality that also pairs null with null."""
    return left.eqNullSafe(right)

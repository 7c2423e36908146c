"""Quality scores by compression against dictionaries of good and of bad text.

Two zstandard dictionaries are trained on stretches of labelled text, one of good and one of
bad documents. A text is compressed whole, block by block, with each of them. The difference
of the two sizes over their sum, with how far the text compresses at all (repetition), goes
through a logistic curve that is fitted on other labelled documents.

Bounds, all parameters: each dictionary comes from at most `SAMPLE` labelled documents of its
class and two stretches of `STRETCH` characters of each, from hashed places; the curve from at
most `SAMPLE` other documents of each class, read whole and weighted by the class counts of
all usable labels. Scores are given to every row.

Cases: null and empty texts take the curve's value for an empty text; a null key is scored
and isn't held out; labels that are null or name no document are not used; a document with
several labels counts with each; repeated rows are scored each; without labels of both
classes every score is the share of good labels (one half without labels); an empty table
gives an empty table; other columns are kept out of the way by selecting first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from depotlane.llm.tables import read

SAMPLE = 3000
STRETCH = 1024
DICTIONARY_BYTES = 112_640
BLOCK = 2048
LEVEL = 3
GOOD_FROM = 0.7


def fold(key: Column) -> Column:
    """Remainder by 4 of the CRC of the key as text; 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Sizes:
    """Compressed sizes of a text with each dictionary."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.compress = []
        for content in dictionaries:
            held = zstandard.ZstdCompressionDict(content) if content else None
            if held:
                held.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False).compress)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Normalised difference, compressed share, and repetition beyond that of prose."""
        data = text.encode() if text else b""
        bad = good = 0
        compress_bad, compress_good = self.compress
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            bad += len(compress_bad(block))
            good += len(compress_good(block))
        share = (good + bad) / (2 * len(data) + 64)
        return (bad - good) / (bad + good + 16), share, max(0.0, 0.3 - share)


def curve(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge: constant, then a weight for each feature."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.array([1e-6] + [1e-3] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (y - p)) - ridge * beta
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        beta += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _sample(docs: DataFrame, labels: DataFrame, folds: list[int], key: str, text: str) -> DataFrame:
    """At most SAMPLE labelled documents of each class in these folds: key, text, y."""
    usable = labels.where(F.col("quality").isin(0, 1) & fold(F.col(key)).isin(folds)).select(key, F.col("quality").cast("int").alias("y"))
    picks = [usable.where(F.col("y") == y).orderBy(F.xxhash64(key, F.lit(71)), key).limit(SAMPLE) for y in (0, 1)]
    few = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * SAMPLE pairs of numbers
    return docs.select(docs[key].alias(key), docs[text].cast("string").alias("text")).join(few, key).where("text != ''")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """Learns from labels outside fold 2; the result adds a last column, score, to tables with the text.

    A column of the table that has this name already must be renamed or nested before.
    """
    place = lambda salt: F.substring("text", F.pmod(F.xxhash64(key, F.lit(salt)), F.greatest(F.length("text") - STRETCH + 1, F.lit(1))).cast("int") + 1, F.lit(STRETCH))
    parts = _sample(docs, labels, [0, 1], key, text)
    parts = parts.select("y", F.explode(F.array(place(1), place(2))).alias("part")).orderBy("part").collect()
    kept = tuple(dictionary([r.part.encode() for r in parts if r.y == y]) for y in (0, 1))
    counts = dict(labels.where(F.col("quality").isin(0, 1) & (fold(F.col(key)) == 3)).groupBy("quality").count().collect())
    if not all(kept) or len(counts) < 2:
        share = sum(r.y for r in parts) / len(parts) if parts else 0.5
        return lambda df: df.withColumn("score", F.lit(float(share)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(kept)
        for batch in batches:
            found = [sizes.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(f) for f in found], pa.list_(pa.float64()))], ["y", "x"])

    shown = _sample(docs, labels, [3], key, text).select("y", "text").mapInArrow(measure, "y int, x array<double>").collect()
    shown.sort(key=lambda r: (r.y, r.x))
    y = np.array([r.y for r in shown])
    each = np.array([counts[k] / max(1, (y == k).sum()) for k in (0, 1)])
    weights = each[y] * len(y) / sum(counts.values())
    beta = curve(np.array([r.x for r in shown]), y, weights).tolist()

    def score(df: DataFrame) -> DataFrame:
        at = df.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes = Sizes(kept)
            for batch in batches:
                x = np.array([(1.0, *sizes.features(t)) for t in batch.column(at).to_pylist()]).reshape(-1, 4)
                scores = 1 / (1 + np.exp(-np.clip(x @ np.array(beta), -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField("score", DoubleType())]))

    return score


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit(docs, read(spark, sf_dir, "labels"))(docs)
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0).alias("predicted")
    )


QUERIES, ORACLES = {"op1_quality": op1_quality}, {}

"""Benchmark decontamination by Wu-Manber search over words.

Every 13 consecutive words of a benchmark item are a pattern; an item of fewer words is one
pattern. Patterns of one length are searched together: the last two words under the end of
the search window look up a shift, which skips positions where no pattern can end; where
the shift is zero, the suffix selects a bucket of patterns, and comparing their words
confirms occurrences. Patterns go to the tasks in blocks of about `PATTERNS_AT_ONCE` patterns and
`BYTES_AT_ONCE` bytes at most, so what is broadcast stays bounded however large the benchmark is;
a larger benchmark takes further passes over the documents. Each pass is written before the next
starts and its patterns are given up, so driver and workers hold one block at a time.

Cases: a null or empty text has no words and is never contaminated; items without words
occur nowhere; equal items are all reported; a null item_id is not listed; repeated rows
are judged each; an empty benchmark leaves every document clean; input columns other than
the named ones are ignored. Texts are searched whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from depotlane.llm.tables import cut, read

#: A word: ASCII digits and lower-case letters, and all that is not ASCII (as bytes of UTF-8).
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same for Spark, over text whose A-Z are lower-cased.
SPARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WINDOW = 13
#: Patterns in one pass over the documents: about 100 MB in a Python worker.
PATTERNS_AT_ONCE = 100_000
#: Bytes of the patterns of one pass, and of the names of their items.
BYTES_AT_ONCE = 1 << 25


def words(text: str | None) -> list[bytes]:
    """The words of a text; bytes.lower changes A-Z alone."""
    return WORD.findall(text.encode().lower()) if text else []


def patterns(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct patterns, each with the items that hold it: columns words, items."""
    own = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = own.select("item", F.regexp_extract_all(lower, F.lit(SPARK_WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    own = own.select("item", "w", F.explode(starts).alias("at"))
    own = own.select("item", F.array_join(F.slice("w", F.col("at"), window), " ").alias("words"))
    return own.groupBy("words").agg(F.collect_set("item").alias("items"))


class Searcher:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, length: int, found: list[tuple[list[bytes], tuple[str, ...]]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict[object, dict[tuple[bytes, ...], tuple[str, ...]]] = {}
        for pattern, items in found:
            for end in range(self.block, length + 1):
                key = self.key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket.setdefault(self.key(pattern, length), {})[tuple(pattern)] = items

    def key(self, text: list[bytes], end: int):
        return text[end - 1] if self.block == 1 else (text[end - 2], text[end - 1])

    def search(self, text: list[bytes]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """Start and items of each occurrence."""
        length, end, size, far, shift = self.length, self.length, len(text), self.far, self.shift.get
        single = self.block == 1
        while end <= size:
            key = text[end - 1] if single else (text[end - 2], text[end - 1])
            step = shift(key, far)
            if step == 0:
                start = end - length
                items = self.bucket[key].get(tuple(text[start:end]))
                if items is not None:
                    yield start, items
                step = 1
            end += step


def searchers(rows: list) -> list[Searcher]:
    by_length: dict[int, list] = {}
    for row in rows:
        pattern = row["words"].encode().split(b" ")
        by_length.setdefault(len(pattern), []).append((pattern, tuple(row["items"])))
    return [Searcher(length, found) for length, found in sorted(by_length.items())]


def merged(spans: list[list[int]]) -> list[list[int]]:
    """The same coverage by spans that neither meet nor overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _search(state: DataFrame, rows: list) -> tuple[DataFrame, Broadcast]:
    """One pass, and its tables: what earlier passes found travels with each row, so no join is needed."""
    tables = state.sparkSession.sparkContext.broadcast(searchers(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, texts, _, items, spans = batch.columns
            counts, items, spans = [], items.to_pylist(), spans.to_pylist()
            for i, text in enumerate(texts.to_pylist()):
                own, more = words(text), set(items[i])
                counts.append(len(own))
                for table in tables.value:
                    for start, found in table.search(own):
                        more.update(found)
                        spans[i].append([start, start + table.length])
                items[i], spans[i] = sorted(more), merged(spans[i])
            arrays = pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([key, texts, *arrays], batch.schema.names)

    return state.mapInArrow(run, state.schema), tables


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", at_once: int = PATTERNS_AT_ONCE, bytes_at_once: int = BYTES_AT_ONCE
) -> DataFrame:
    """`key`, text, n_words, n_hit, items (sorted strings), spans (of hit words) and contaminated, for each row of `docs`."""
    found = patterns(benchmark)
    size = F.octet_length("words") + F.aggregate("items", F.lit(0).cast("long"), lambda n, item: n + F.octet_length(item))
    n, total = found.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(-(-n // at_once), -(-total // bytes_at_once))
    state = docs.select(
        docs[key].alias("key"), docs[text].cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"), F.array().cast("array<array<int>>").alias("spans"),
    )
    if blocks <= 1:
        state, _ = _search(state, found.collect())
    else:  # twice as many blocks by hash, so that each stays below the bound
        dealt = cut(found.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(2 * blocks))))
        for block in range(2 * blocks):
            passed, tables = _search(state, dealt.where(F.col("block") == block).select("words", "items").collect())
            state = cut(passed)
            tables.destroy()  # what is written needs them no more
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    out = state.select(F.col("key").alias(key), F.col("text").alias(text), "n_words", hits.alias("n_hit"), "items", "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


_ORACLE = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), split AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), p AS (
  SELECT DISTINCT id AS item_id, len(x) AS n, array_to_string(x, ' ') AS s FROM (
    SELECT id, unnest([w[i:i + 12] FOR i IN range(1, greatest(1, len(w) - 12) + 1)]) AS x FROM split WHERE side = 'b' AND len(w) > 0)
), c AS (
  SELECT id AS doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM split, (SELECT DISTINCT n FROM p) AS lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE side = 'd'
), h AS (SELECT c.doc_id, c.i, c.n, p.item_id FROM c JOIN p ON c.n = p.n AND c.s = p.s),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM split LEFT JOIN hit ON hit.doc_id = id LEFT JOIN it ON it.doc_id = id WHERE side = 'd'
"""

QUERIES, ORACLES = {"op7_contamination": op7_contamination}, {"op7_contamination": _ORACLE}

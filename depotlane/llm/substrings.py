"""Substring dedup by super-k-mers of words.

Windows of 20 words are too many to ship one by one. Consecutive windows that share a
minimiser (the 3-word run of least hash in the window) form a super-k-mer; equal windows have
equal minimisers at equal places, so only super-k-mers of one minimiser need comparing.

1. Minimisers are counted; one that occurs once can't repeat a window and is dropped.
2. What is left is aggregated by minimiser and content (64-bit hashes each): of equal
   super-k-mers all but the first are repeated as a whole. This happens before any bucket is
   formed, so thousands of copies cost one row there.
3. Where a minimiser has several contents, the first occurrence of each travels as one packed
   string of words to the minimiser's bucket, where sorting its windows tells exactly which
   of them start earlier elsewhere. A bucket of more than `BUCKET` strings is not gathered:
   its windows are unpacked and grouped by their words, with partial aggregation.
4. The spans found go to their documents, and the words left are kept.

Cases: a null or empty text has no words and keeps the empty text; a text of fewer than 20
words loses nothing; a null key comes after all others; rows that repeat a key and text are
one document and get one result each, rows that share a key only are ordered by a hash of
the text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from depotlane.llm.shingles import offsets, run_hashes, word_hashes
from depotlane.llm.tables import cut, read, slices

WINDOW = 20
#: Words in a minimiser.
MINIMISER = 3
#: Strings that one bucket gathers: some 40,000 windows, or 30 MB in a worker.
BUCKET = 4096
#: Bytes of text whose words a worker holds at once (a longer text is held alone).
PIECE = 2_000_000

_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_PLACE = np.uint64(2**24 - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def super_kmers(texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """text index, first window, number of windows, minimiser and content hash of each super-k-mer."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(lengths.sum())
    empty = np.empty(0, np.int64)
    if not len(texts) or lengths.max() < WINDOW:
        return empty, empty, empty, empty, empty
    if total > int(_PLACE) and len(texts) > 1:  # places are packed in 24 bits: halve the batch
        half = len(texts) // 2
        a, b = super_kmers(texts[:half]), super_kmers(texts[half:])
        return tuple(np.concatenate([x, y + half if k == 0 else y]) for k, (x, y) in enumerate(zip(a, b, strict=True)))
    words = np.concatenate([word_hashes(w) for w in texts])
    runs = run_hashes(words, MINIMISER)
    places = np.arange(len(runs), dtype=np.uint64)
    if total <= int(_PLACE):
        least = (runs & ~_PLACE) | places
        span, reach = WINDOW - MINIMISER + 1, 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        at = (least & _PLACE).astype(np.int64)
    else:  # one text of more than 16 million words
        at = np.empty(total - WINDOW + 1, np.int64)
        for a in range(0, len(at), 2**20):
            own = runs[a : a + 2**20 + WINDOW - MINIMISER]
            views = np.lib.stride_tricks.sliding_window_view(own, WINDOW - MINIMISER + 1)
            at[a : a + len(views)] = a + np.arange(len(views)) + views.argmin(axis=1)
    begins = offsets(lengths)
    text_of = np.repeat(np.arange(len(texts)), lengths)[: len(at)]
    first = np.arange(len(at)) - begins[text_of]
    valid = np.flatnonzero(first + WINDOW <= lengths[text_of])
    at, text_of, first = at[valid], text_of[valid], first[valid]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text_of[1:] != text_of[:-1])]))
    counts = np.diff(np.concatenate([head, [len(at)]]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, total), dtype=np.uint64)])
    start = valid[head]
    content = (sums[start + counts + WINDOW - 1] - sums[start]) * _powers(_UNBASE, total)[start]
    return text_of[head], first[head], counts, runs[at[head]].view(np.int64), content.view(np.int64)


def _words(texts: pa.Array) -> Iterator[list[bytes]]:
    """The words of one text after the other; bytes.split() parts at space and 09 to 0D."""
    for t in texts:
        yield t.as_py().encode().split() if t.is_valid else []


def _records(docs: DataFrame, only_minimisers: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, 1, PIECE)):
            at, first, n, minimiser, content = super_kmers(list(_words(batch.column(1))))
            if only_minimisers:
                yield pa.RecordBatch.from_arrays([pa.array(minimiser)], ["v"])
            else:
                rows = batch.column(0).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(minimiser), pa.array(content), rows, pa.array(first * 32 + n)], ["v", "h", "row", "place"])

    kind = docs.schema["row"].dataType.simpleString()
    return docs.mapInArrow(run, "v long" if only_minimisers else f"v long, h long, row {kind}, place long")


def _compressed(docs: DataFrame) -> DataFrame:
    """The same rows with the text compressed, for joins by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [compress(t.encode()) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["row", "text"])

    return docs.mapInArrow(run, f"row {docs.schema['row'].dataType.simpleString()}, text binary")


def _unpacked(texts: pa.Array) -> Iterator[list[bytes]]:
    """The words of one compressed text after the other."""
    decompress = zstandard.ZstdDecompressor().decompress
    for t in texts:
        yield decompress(t.as_py()).split() if len(t.as_buffer()) else []


def _packed(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of super-k-mers (row, v, place, size) as packed strings; texts as from _compressed."""
    per_row = wanted.groupBy("row").agg(F.collect_list(F.struct("v", "place", "size")).alias("parts"))
    # the same outer join as for the result, so that the texts are shuffled once for both
    joined = texts.join(per_row, "row", "left").select("row", "text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(2)))
            at, columns = [], [[], [], [], []]
            for i, (words, parts) in enumerate(zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True)):
                for p in parts:
                    at.append(i)
                    start, n = divmod(p["place"], 32)
                    row = p["v"], p["size"], start, b" ".join(words[start : start + n + WINDOW - 1]).decode()
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.string()
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], ["row", "v", "size", "start", "words"])

    kind = texts.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {kind}, v long, size long, start int, words string")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: windows that start earlier in another string of the bucket, as spans."""

    def settle(group: list[tuple]) -> list[tuple]:
        windows = []
        for order, (row, start, packed) in enumerate(group):
            words = packed.split(" ")
            windows += [(words[i : i + WINDOW], order, start + i) for i in range(len(words) - WINDOW + 1)]
        windows.sort()  # equal windows lie together, the earliest first: rows came in order
        found = []
        for (a, _, _), (b, order, at) in zip(windows, windows[1:]):
            if a == b:
                found.append((group[order][0], at))
        return found

    held: list[tuple] = []
    bucket, kind = None, None
    for batch in batches:
        kind = batch.schema.field("row").type
        rows, buckets, starts, strings = batch.column(0), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        found = []
        for i, (v, start, packed) in enumerate(zip(buckets, starts, strings, strict=True)):
            if v != bucket:
                found += settle(held) if len(held) > 1 else []
                held, bucket = [], v
            held.append((rows[i], start, packed))
        yield _spans(found, kind)
    if len(held) > 1:
        yield _spans(settle(held), kind)


def _spans(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    starts = np.array([at for _, at in found], np.int32)
    rows = pa.array([r.as_py() for r, _ in found], kind)
    return pa.RecordBatch.from_arrays([rows, pa.array(starts), pa.array(starts + np.int32(WINDOW))], ["row", "a", "b"])


def repeated(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans (row, a, b) of words in windows that start earlier elsewhere; docs: row, text, and texts the same compressed."""
    common = _records(docs, True).groupBy("v").count().where("count > 1").select("v")
    found = cut(_records(docs, False).join(common, "v", "left_semi"))
    firsts = cut(found.groupBy("v", "h").agg(F.min(F.struct("row", "place")).alias("first")))
    whole = found.join(firsts, ["v", "h"]).where("struct(row, place) != first")
    start, n = F.floor(F.col("place") / 32).cast("int"), (F.col("place") % 32).cast("int")
    whole = whole.select("row", start.alias("a"), (start + n + (WINDOW - 1)).alias("b"))
    several = firsts.groupBy("v").agg(F.count("*").alias("size")).where("size > 1")
    mixed = cut(firsts.join(several, "v").select("v", "size", "first.row", "first.place"))
    packed = _packed(texts, mixed)
    kind = docs.schema["row"].dataType.simpleString()
    few = packed.where(F.col("size") <= BUCKET)
    few = few.repartition("v").sortWithinPartitions("v", "row", "start").mapInArrow(_buckets, f"row {kind}, a int, b int")
    many = packed.where(F.col("size") > BUCKET).select("row", "start", F.split("words", " ").alias("w"))
    many = many.select("row", "start", "w", F.explode(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1))).alias("i"))
    many = many.select("row", (F.col("start") + F.col("i") - 1).alias("a"), F.array_join(F.slice("w", F.col("i"), WINDOW), " ").alias("window"))
    least = many.groupBy("window").agg(F.min(F.struct("row", "a")).alias("first"))
    later = many.join(least, "window").where("struct(row, a) != first").select("row", "a", (F.col("a") + WINDOW).alias("b"))
    return whole.unionByName(few).unionByName(later)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_words, n_removed and kept (the words left, joined by one space) for each row."""
    own = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    plain = own.groupBy("key").count().where("count > 1 or key is null").isEmpty()
    row = F.col("key") if plain else F.struct(F.col("key").isNull().alias("absent"), "key", F.xxhash64("text").alias("mark"))
    own = own.select(row.alias("row"), "text")
    texts = _compressed(own)
    spans = repeated(own, texts).groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = texts.join(spans, "row", "left").select(F.col("row" if plain else "row.key").alias("key"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for words, spans in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                left = words
                if spans:
                    keep = np.ones(len(words), bool)
                    for s in spans:
                        keep[s["a"] : s["b"]] = False
                    left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"key {kind}, n_words long, n_removed long, kept string").withColumnRenamed("key", key)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM later),
word AS (SELECT doc_id, i AS pos, w[i] AS s FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT doc_id, string_agg(s, ' ' ORDER BY pos) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES, ORACLES = {"op2_substrings": op2_substrings}, {"op2_substrings": _ORACLE}

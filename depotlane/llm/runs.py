"""Periodic runs of words, by minimizers at several scales.

A run is a stretch of words with smallest period q (words q apart are the same) that no
neighbouring word extends keeping q, of at least `LEAST` words and `TURNS` periods.

Periods up to `SHORT` are found by comparing the words at each lag directly. Longer ones fall
into scales: a scale of width w takes periods q with 2w/3 < q <= w. It hashes every w words and
keeps, of every w consecutive hashes, the least (all of them where several are equal). A run holds 2w - 1 + q
words or more, so it holds one such window and the window q later, whose words are the same;
both keep the same place within them. As w >= q, equal hashes inside a run are never
less than q apart, so the next kept place with the same hash lies exactly q later: consecutive
equal minimizers are the only seeds needed. Each seed is extended by comparing the
words themselves, so a hash never decides, and stretches whose period is a
multiple of a smaller one are left to that one.

Short documents share one array, with a word of its own after each, which no run can hold.
Time and memory grow with the words of a document times the logarithm of its length.

Cases: null and empty texts have no runs; a null key is an ordinary row (and is never edited by
the query's edit); repeated rows are judged each; of equally good runs the earliest, then that of the
least period is the best; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from depotlane.llm.shingles import FACTOR, mix
from depotlane.llm.tables import read, slices

LEAST, TURNS = 6, 4
#: Longest period that is found by comparing words at each lag.
SHORT = 8
#: Bytes of text that a worker takes at a time (a longer text is one slice).
SLICE = 600_000

Run = tuple[int, int, int]


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """(low, width): the periods above low, up to width, until `longest` is covered."""
    low = SHORT
    while low < longest:
        width = low * 3 // 2
        yield low, width
        low = width


def _spans(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """The best (np.minimum or np.maximum) of every `size` consecutive values."""
    width = 1
    while 2 * width <= size:
        values = best(values[:-width], values[width:])
        width *= 2
    return best(values[: len(values) - (size - width)], values[size - width :]) if width < size else values


def _hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive words."""
    h, width = mix(words.astype(np.uint64)), 1
    while width < size:
        step = min(width, size - width)
        h = h[:-step] * FACTOR + h[step:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        width += step
    return h


def seeds(words: np.ndarray, low: int, width: int) -> np.ndarray:
    """(lag, place) of consecutive equal minimizers of a scale, by lag and place."""
    if len(words) < 2 * width:
        return np.empty((0, 2), np.int64)
    h = _hashes(words, width)
    least = _spans(h, min(width, len(h)), np.minimum)
    edge = np.zeros(len(h) - len(least), np.uint64)
    kept = np.flatnonzero(_spans(np.concatenate([edge, least, edge]), len(edge) + 1, np.maximum) == h)
    order = kept[np.argsort(h[kept], kind="stable")]
    first, lag = order[:-1], np.diff(order)
    use = (h[order[1:]] == h[first]) & (lag > low) & (lag <= width)
    first, lag = first[use], lag[use]
    by = np.lexsort((first, lag))
    return np.column_stack([lag[by], first[by]])


def _agree(left: np.ndarray, right: np.ndarray) -> int:
    """Number of leading places where two arrays hold the same."""
    size, at = min(len(left), len(right)), 0
    step = 64
    while at < size:
        end = min(at + step, size)
        differ = left[at:end] != right[at:end]
        if (k := int(differ.argmax())) or differ[0]:
            return at + k
        at, step = end, step * 2
    return size


def _smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of at least two periods has no smaller one: by its prime factors."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            less = period // factor
            if np.array_equal(words[start : start + period], words[start + less : start + less + period]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _long(length: int | np.ndarray, period: int):
    return length >= max(LEAST, TURNS * period)


def stretches(words: np.ndarray) -> list[Run]:
    """Runs (start, length, period) of at most SHORT words a period."""
    found = []
    for lag in range(1, min(SHORT, len(words) // TURNS) + 1):
        same = np.zeros(len(words) - lag + 2, np.int8)
        same[1:-1] = words[lag:] == words[:-lag]
        edges = np.flatnonzero(np.diff(same))
        starts, lengths = edges[::2], edges[1::2] - edges[::2] + lag
        use = _long(lengths, lag)
        found += [(s, n, lag) for s, n in zip(starts[use].tolist(), lengths[use].tolist()) if _smallest(words, s, lag)]
    return found


def extended(words: np.ndarray, pairs: np.ndarray) -> list[Run]:
    """Runs that the seeds of a scale lead to."""
    found, now, end = [], 0, 0
    for lag, place in pairs.tolist():
        if lag == now and place < end:
            continue  # inside the stretch of an earlier seed of this lag
        after = _agree(words[place:], words[place + lag :])
        before = _agree(words[:place][::-1], words[lag : place + lag][::-1])
        start, now, end = place - before, lag, place + after
        length = before + after + lag
        if _long(length, lag) and _smallest(words, start, lag):
            found.append((start, length, lag))
    return found


def runs(documents: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each document, by start and period; documents are arrays of word numbers from 0."""
    found: list[list[Run]] = [[] for _ in documents]
    longest = max(map(len, documents), default=0) // TURNS
    apart = 1 + max((int(d.max()) for d in documents if len(d)), default=0)
    for low, width in [(0, 0), *scales(longest)]:
        chosen = [i for i, d in enumerate(documents) if len(d) >= max(LEAST, TURNS * (low + 1))]
        if not chosen:
            break
        joined = np.concatenate([x for i in chosen for x in (documents[i], np.array([apart + i]))])
        starts = np.cumsum([0, *(len(documents[i]) + 1 for i in chosen)])
        for start, length, period in extended(joined, seeds(joined, low, width)) if low else stretches(joined):
            k = int(np.searchsorted(starts, start, "right")) - 1
            found[chosen[k]].append((start - int(starts[k]), length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def numbered(documents: list[list[bytes]]) -> list[np.ndarray]:
    """Each word as the number of its first place among the distinct words."""
    known = dict.fromkeys(w for words in documents for w in words)
    known = dict(zip(known, range(len(known))))
    return [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in documents]


def best(found: list[Run]) -> Run | None:
    """The run of most periods (exact); of equal ones the earliest, then that of the least period."""
    top = None
    for run in found:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words but those after the first period of any run."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join(compress(words, keep.tolist()))


def planted(words: list[bytes], key: str | None) -> list[bytes]:
    """The contract's edit: one text in ten repeats from some word on, by the CRC of its key."""
    n, h = len(words), zlib.crc32(key.encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _part(name: str) -> Callable:
    at = ("start", "length", "period").index(name)
    return lambda words, found, top: top and top[at]


#: What `detect` can return of a text: name, Spark's type, Arrow's type, and the value from words, runs and best run.
OUTPUTS = {
    "n_runs": ("long", pa.int64(), lambda words, found, top: len(found)),
    "start": ("long", pa.int64(), _part("start")),
    "length": ("long", pa.int64(), _part("length")),
    "period": ("long", pa.int64(), _part("period")),
    "exponent_milli": ("long", pa.int64(), lambda words, found, top: top and 1000 * top[1] // top[2]),
    "runs": ("array<struct<start:bigint,length:bigint,period:bigint>>", pa.list_(_RUN), lambda words, found, top: [dict(zip(("start", "length", "period"), r)) for r in found]),
    "collapsed": ("string", pa.string(), lambda words, found, top: collapsed(words, found).decode()),
    "runs_sha256": ("string", pa.string(), lambda words, found, top: hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest()),
    "collapsed_sha256": ("string", pa.string(), lambda words, found, top: hashlib.sha256(collapsed(words, found)).hexdigest()),
}


def detect(
    df: DataFrame, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_runs", "runs", "collapsed"),
    edit: Callable[[list[bytes], str | None], list[bytes]] | None = None,
) -> DataFrame:
    """`key` and the named OUTPUTS for each row; `edit` may change the words of a text, given the key as text.

    Every text is judged where it is read: no rows move between tasks.
    """
    makers = [OUTPUTS[name] for name in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, SLICE)):
            # bytes.split knows ASCII alone: 20 and 09 to 0D
            texts = [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in batch.column(2)]
            if edit:
                texts = [edit(words, name.as_py()) for words, name in zip(texts, batch.column(1))]
            columns = [[] for _ in makers]
            for words, found in zip(texts, runs(numbered(texts))):
                top = best(found)
                for column, (_, _, make) in zip(columns, makers, strict=True):
                    column.append(make(words, found, top))
            arrays = [pa.array(column, kind) for column, (_, kind, _) in zip(columns, makers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["key", *outputs])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("key"), df[key].cast("string").alias("name"), df[text].cast("string").alias("text"))
    return out.mapInArrow(run, f"key {kind}, " + ", ".join(f"{name} {OUTPUTS[name][0]}" for name in outputs)).withColumnRenamed("key", key)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return detect(read(spark, sf_dir, "documents"), outputs=names, edit=planted)


QUERIES, ORACLES = {"op12_runs": op12_runs}, {}

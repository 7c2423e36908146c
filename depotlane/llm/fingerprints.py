"""One-permutation MinHash fingerprints, in DataFrame functions alone.

Each five-word shingle is hashed once. The top bits of the hash choose one of `BINS` bins and
each bin keeps its least hash: hashes and one sentinel for each bin (the largest hash there)
are sorted together, and the first of each bin is taken. An empty bin borrows from the first
full bin in an order of its own (a_b * t + c_b modulo BINS, a_b odd, so every bin is reached):
optimal densification. `BITS` low-order bits of each minimum, packed as hex digits, are the
fingerprint. Likeness is the share of equal digits, corrected for those equal by chance.

Cases: null and empty texts, and texts without words, have the empty fingerprint, which is
like itself (1) and like nothing else (0); a text of fewer than five words is one shingle;
a single row is its own successor; a null key comes last; rows with equal keys are ordered by a
hash of the text, then by the text; rows that repeat key and text follow each other, in one task;
keys may be of any type that Spark orders; an empty table gives an empty table; other columns
are ignored. Letters are compared in lower case.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DataType

from depotlane.llm.tables import SPACE, read, text_of

WORDS = 5
BINS, BITS = 256, 4
#: Tries before an empty bin ranks all full bins.
TRIES = 6
#: Rows in a block of the order, at least, blocks at most, and sampled rows for each block.
BLOCK_ROWS, BLOCKS, SAMPLED = 2048, 20_000, 30

_RULE = random.Random(17)
STEPS = [2 * _RULE.randrange(BINS // 2) + 1 for _ in range(BINS)]
BEGINS = [_RULE.randrange(BINS) for _ in range(BINS)]
BACK = [pow(a, -1, BINS) for a in STEPS]
_SHIFT, _REST = 64 - 8, (1 << (64 - 8)) - 1
SENTINELS = [((b - BINS // 2) << _SHIFT) | _REST for b in range(BINS)]


def _table(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with a fingerprint of a text column, as a string of BINS hex digits."""
    kept = df.columns
    df = df.withColumn("_w", F.filter(F.split(F.lower(F.col(text)), SPACE), lambda w: w != ""))
    shingle = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WORDS)])
    hashes = F.when(F.size("_w") >= WORDS, F.transform(F.sequence(F.lit(0), F.size("_w") - WORDS), shingle)).otherwise(F.array(F.xxhash64("_w")))
    df = df.withColumn("_h", F.sort_array(F.concat(hashes, _table(SENTINELS))))
    part = lambda x: F.shiftright(x, _SHIFT)
    df = df.withColumn("_m", F.filter("_h", lambda x, i: (i == 0) | (part(x) != part(F.get("_h", i - 1)))))
    full = lambda x: x.bitwiseAND(F.lit(_REST)) != F.lit(_REST)
    df = df.withColumn("_full", F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: full(F.get("_m", b))))
    steps, begins, back = _table(STEPS), _table(BEGINS), _table(BACK)

    def borrowed(b: Column) -> Column:
        tries = []
        for t in range(TRIES):
            x = F.get("_m", (F.get(steps, b) * t + F.get(begins, b)).bitwiseAND(F.lit(BINS - 1)))
            tries.append(F.when(full(x), x))
        rank = lambda y: ((y - F.get(begins, b)) * F.get(back, b)).bitwiseAND(F.lit(BINS - 1)) * BINS + y
        best = F.array_min(F.transform("_full", rank)).bitwiseAND(F.lit(BINS - 1))
        return F.xxhash64(F.coalesce(*tries, F.get("_m", best)), b)  # so that few shingles don't decide all bins alike

    digits = F.transform("_m", lambda x, b: F.lower(F.hex(F.when(full(x), x).otherwise(borrowed(b)).bitwiseAND(F.lit((1 << BITS) - 1)))))
    whole = F.when(F.size("_w") == 0, F.lit("")).otherwise(F.array_join(digits, ""))
    return df.select(*kept, whole.alias(name))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints."""
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda z: z)) / BINS
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col(a) == "") | (F.col(b) == ""), F.lit(0.0)).otherwise(estimate)


def bounds(df: DataFrame, blocks: int, n: int) -> list:
    """At most blocks - 1 values of `place`, ascending, that part the rows into nearly equal blocks, from a sample of `SAMPLED` rows a block.

    The sample chooses where blocks end, which no result depends on.
    """
    if blocks < 2:
        return []
    shown = df.sample(min(1.0, SAMPLED * blocks / n), 29).groupBy().agg(F.to_json(F.sort_array(F.collect_list("place"))).alias("found"))
    found = json.loads(shown.first().found)  # at most about SAMPLED * BLOCKS pairs of a key and a number
    step = max(1, len(found) // blocks)
    out = found[step::step]
    return [v for k, v in enumerate(out) if k == 0 or v != out[k - 1]]


def block_of(found: list, place: DataType) -> Column:
    """How many of `found` are at most `place`, by halving: the bounds are one literal."""
    if not found:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(found)), ArrayType(place))
    halves = [1 << k for k in reversed(range(len(found).bit_length()))]
    take = lambda at, half: F.when(F.get(table, at + half - 1) <= F.col("place"), at + half).otherwise(at)
    return F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), take)


def with_next(df: DataFrame) -> DataFrame:
    """key, text, fingerprint and next_text, next_fingerprint of the next row in descending key order; the first row follows the last.

    Rows are placed by key and by a hash of the text, so that many rows without a key, or with
    one key, part as others do, and go to blocks between quantiles of a sample. The first row of
    each block is sent once more, to the end of the block before it, where it follows the last
    row; so texts move in one shuffle and nothing is broadcast but the places of first rows.
    """
    n = df.count()
    blocks = max(1, min(BLOCKS, n // BLOCK_ROWS))
    df = df.withColumn("mark", F.xxhash64("text"))
    df = df.withColumn("place", F.struct("key", "mark"))
    df = df.withColumn("block", block_of(bounds(df, blocks, n), df.schema["place"].dataType))
    tops = df.groupBy("block").agg(F.max("place").alias("top"))
    around = Window.orderBy(F.col("block").desc())  # over at most BLOCKS rows of three numbers
    last = F.last("block").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select(F.col("top.key").alias("top_key"), F.col("top.mark").alias("top_mark"), F.coalesce(F.lag("block").over(around), last).alias("ends"))
    firsts = df.join(F.broadcast(tops), (F.col("mark") == F.col("top_mark")) & F.col("key").eqNullSafe(F.col("top_key")))
    firsts = firsts.groupBy("ends", "key", "mark").agg(F.max("text").alias("text")).select("key", "text", "mark", F.col("ends").alias("block"))
    both = df.select("key", "text", "mark", "block", F.lit(0).alias("sent")).unionByName(firsts.withColumn("sent", F.lit(1)))
    both = with_fingerprint(both, "text", "fingerprint")
    inside = Window.partitionBy("block").orderBy("sent", F.col("key").desc_nulls_last(), F.col("mark").desc(), F.col("text").desc())
    out = both.withColumn("following", F.lead(F.struct("text", "fingerprint")).over(inside)).where("sent = 0")
    return out.select("key", "text", "fingerprint", F.col("following.text").alias("next_text"), F.col("following.fingerprint").alias("next_fingerprint"))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprint of each text and of its edited text, and how like they and the next text are."""
    own = df.select(df[key].alias("key"), text_of(text).alias("text"))
    own = with_next(own)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    own = own.withColumn("edited", edited)
    own = with_fingerprint(own, "edited", "edited_fingerprint")
    return own.select(
        F.col("key").alias(key), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op4_fingerprints": op4_fingerprints}, {}

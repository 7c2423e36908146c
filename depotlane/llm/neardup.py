"""MinHash near-dedup: links, components and the documents to keep.

1. A task turns each text into its set of word shingles, the minima of `MINIMA`
   universal hash functions over it, and a digest of the set.
2. Equal sets become one node (aggregated before any pairing), so copies cost nothing more.
3. Rows of the signature are banded. Buckets are worked on in rounds: a round pairs a node
   with the least node of another component in one of its buckets, once each, so it has no
   more pairs than nodes; its links merge components. What shares buckets but no component
   after the last round is joined exactly: links between two sets need a common shingle among
   the rarest of both (prefix filter), far enough from the end of both to reach the linking
   similarity (position filter), and parity bits of the sets that differ in few places; so texts
   of one template that aren't linked rarely make a pair.
4. Signatures verify a pair roughly, then the full sets decide it exactly.
5. Components of the links come from alternating large-star and small-star.

At a linking similarity of 0.85 the chance that a linked pair shares no bucket is
(1 - 0.85**6)**32 = 3e-7, at 0.80 (1 - 0.80**5)**38 = 3e-7. Shingles are compared by 64-bit hashes of their words.

Cases: null texts and texts without words have no shingles, are linked with nothing and are
kept; a text of fewer than five words is one shingle; repeated rows share a component whose
id is the least key, each row being kept whose key is that id; a null key comes after all
others and is kept only if no other key is in its component; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from depotlane.llm.components import components
from depotlane.llm.shingles import digest, mix, offsets, shingle_set
from depotlane.llm.tables import cut, read, slices

WORDS = 5
MINIMA = 192
#: Links: 100 * intersection >= 85 * union, if no other percentage is given.
PERCENT = 85
#: The chance that a pair at the linking similarity shares no bucket is at most this.
MISSED = 1e-6
#: Nodes (of some 40 bytes each) that may be broadcast to fetch their texts; more are joined.
BROADCAST_ROWS = 500_000
#: Bytes of text that a worker holds as shingles at once.
SLICE = 1_000_000
#: Rounds of one pair for each node, before what is left is joined exactly; fewer where a round finds nothing.
ROUNDS = 3
#: Words of 64 parity bits for each node of the exact join.
PARITIES = 8
#: Shingles of the nodes in one block of the exact join.
SPAN = 16_384

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _RANDOM.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 2**63, MINIMA, dtype=np.uint64)
BAND_SALTS = _RANDOM.integers(0, 2**63, MINIMA, dtype=np.uint64)


def shape(percent: int) -> tuple[int, int]:
    """Bands and rows of a band: as many rows as MISSED allows."""
    return next((MINIMA // r, r) for r in range(MINIMA, 0, -1) if r == 1 or (1 - (percent / 100) ** r) ** (MINIMA // r) <= MISSED)


def roughly(percent: int) -> float:
    """Signatures rule out a pair when their agreement is six standard errors below the linking similarity."""
    return percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / MINIMA) ** 0.5


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of hash minima for each non-empty set."""
    out = np.empty((len(sets), MINIMA), np.uint64)
    at = 0
    while at < len(sets):  # a piece at a time, which stays in the cache
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 32_768):
            size += len(sets[end])
            end += 1
        values = np.concatenate(sets[at:end])
        starts, hashed = offsets(map(len, sets[at:end])), np.empty_like(values)
        for k in range(MINIMA):
            np.multiply(values, FACTORS[k], out=hashed)
            np.add(hashed, SHIFTS[k], out=hashed)
            out[at:end, k] = np.minimum.reduceat(hashed, starts)
        at = end
    return out


def band_keys(minima: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    bands, size = shape(percent)
    parts = minima[:, : bands * size].reshape(len(minima), bands, size)
    keys = np.broadcast_to(BAND_SALTS[:bands], parts.shape[:2]).copy()
    for k in range(size):
        keys = mix(keys ^ (parts[:, :, k] * np.uint64(0x9E3779B97F4A7C15)))
    return keys.view(np.int64)


def profile(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, mark (hash of the text), n_shingles, digest, bands and low bytes of the minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, WORDS) for t in batch.column(2).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            minima = signatures([sets[i] for i in full])
            keys, low = [None] * len(sets), [None] * len(sets)
            for i, k, m in zip(full, band_keys(minima, percent).tolist(), minima, strict=True):
                keys[i], low[i] = k, m.astype(np.uint8).tobytes()
            arrays = [pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary())]
            arrays += [pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["key", "mark", "n_shingles", "digest", "bands", "low"])

    kind = docs.schema["key"].dataType.simpleString()
    rows = docs.select("key", F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(run, f"key {kind}, mark long, n_shingles long, digest binary, bands array<long>, low binary")


def _agree(percent: int) -> Callable:
    """Pairs whose signatures may belong to linked sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, MINIMA) for c in batch.columns[2:4]]
            same = (low[0] == low[1]).mean(axis=1)
            keep = pa.array((same - 1 / 256) / (1 - 1 / 256) >= roughly(percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(keep)

    return run


def _linked(percent: int) -> Callable:
    """Pairs whose full sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last[0] != a:
                    last = a, shingle_set(a, WORDS)
                own = shingle_set(b, WORDS)
                shared = len(np.intersect1d(last[1], own, assume_unique=True))
                keep.append(100 * shared >= percent * (len(last[1]) + len(own) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of distinct nodes, once for each row that has it."""
    wanted = ids.join(nodes.select("node", "key", "mark"), "node")
    wanted = cut(wanted.select("node", F.struct("key", "mark").alias("row")))
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    own = docs.select(F.struct("key", F.xxhash64("text").alias("mark")).alias("row"), "text")
    return own.join(few, "row").select("node", "text")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The linked ones of distinct pairs (u, v): first by signatures, then by full sets."""
    pairs = cut(pairs)
    if pairs.isEmpty():
        return pairs
    low = nodes.select("node", "low")
    rough = pairs.join(low.toDF("u", "low_u"), "u").join(low.toDF("v", "low_v"), "v").select("u", "v", "low_u", "low_v")
    rough = cut(rough.mapInArrow(_agree(percent), "u long, v long"))
    texts = _texts(rough.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, docs)
    full = rough.join(texts.toDF("u", "text_u"), "u").join(texts.toDF("v", "text_v"), "v").select("u", "v", "text_u", "text_v")
    return cut(full.mapInArrow(_linked(percent), "u long, v long"))


def _in_blocks(percent: int) -> Callable:
    """Pairs of one job whose full sets are linked; each text of the job is made a set once."""

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets = {n: shingle_set(t, WORDS) for n, t in zip(texts.column("node").to_pylist(), texts.column("text").to_pylist(), strict=True)}
        keep = []
        for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), strict=True):
            a, b = sets[u], sets[v]
            shared = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
        return pairs.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def decided(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The linked ones of distinct pairs (u, v), for nodes of many pairs: by full sets, pairs of blocks of nodes at a time.

    Nodes of one centre (the least of a node and its partners) lie in blocks of some SPAN shingles,
    so a text travels to a few jobs, not to each of its pairs.
    """
    pairs = cut(pairs)
    if pairs.isEmpty():
        return pairs
    sizes = nodes.select("node", F.col("n_shingles").alias("size"))
    homes = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("home"))
    homes = cut(homes.select("node", F.least("node", "home").alias("home")).join(sizes, "node"))
    totals = homes.groupBy("home").agg(F.sum("size").alias("total"))
    small = totals.where(F.col("total") <= SPAN).agg(F.sum("total")).first()[0] or 0
    parts = F.ceil(F.col("total") / SPAN)
    lump = F.xxhash64(F.lit(-1), F.pmod(F.xxhash64("home"), F.lit(1 + small // SPAN)))
    block = F.when(F.col("total") <= SPAN, lump).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("node"), parts)))
    blocks = homes.join(totals, "home").select("node", block.alias("block"))
    jobs = pairs.join(blocks.toDF("u", "block_u"), "u").join(blocks.toDF("v", "block_v"), "v")
    jobs = cut(jobs.select("u", "v", F.xxhash64(F.least("block_u", "block_v"), F.greatest("block_u", "block_v")).alias("job")))
    wanted = cut(jobs.select("job", F.explode(F.array("u", "v")).alias("node")).distinct())
    texts = _texts(wanted.select("node").distinct(), nodes, docs).join(wanted, "node")
    return cut(jobs.groupBy("job").cogroup(texts.groupBy("job")).applyInArrow(_in_blocks(percent), "u long, v long"))


def _mixed(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """node, bucket, root and `other` (a node of another component) in buckets of several components."""
    root = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = root.groupBy("bucket").agg(F.min(F.struct("root", "node")).alias("low"), F.max(F.struct("root", "node")).alias("high")).where("low.root < high.root")
    other = F.when(F.col("root") == F.col("low.root"), F.col("high.node")).otherwise(F.col("low.node"))
    return root.join(ends, "bucket").select("node", "bucket", "root", other.alias("other"))


def _rounds(members: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of pairs of a node with centres of its buckets, and components of them.

    A round has at most one new pair of each node, with the centre that most of its buckets share.
    """
    links = roots = tried = None
    for _ in range(ROUNDS):
        pairs = _mixed(members, roots).select("node", F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v"))
        pairs = pairs.groupBy("node", "u", "v").agg(F.count("*").alias("times"))
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = cut(pairs.groupBy("node").agg(F.max(F.struct("times", "v", "u")).alias("p")).select("p.u", "p.v").distinct())
        found = verified(pairs, nodes, docs, percent)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            roots = components(links)
        elif roots is not None or pairs.isEmpty():
            break
    return links, components(links) if roots is None else roots


def _shingles(texts: DataFrame) -> DataFrame:
    """node and shingle, once each, of node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            sets = [shingle_set(t.as_py(), WORDS) for t in batch.column(1)]
            for a in range(0, len(sets), 64):
                part = sets[a : a + 64]
                of = pa.array(np.repeat(np.arange(a, a + len(part)), [len(s) for s in part]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(np.concatenate(part).view(np.int64))], ["node", "shingle"])

    return texts.mapInArrow(run, "node long, shingle long")


def _parities(shingles: DataFrame) -> DataFrame:
    """node and parity: bits that tell whether an odd number of the node's shingles falls on them.

    Two sets differ in as many shingles at least as in bits.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("shingle", 8), F.lit(64)).cast("int"))
    words = [F.coalesce(F.bit_xor(F.when(F.pmod("shingle", F.lit(PARITIES)) == i, bit)), F.lit(0).cast("long")).alias(f"p{i}") for i in range(PARITIES)]
    return shingles.groupBy("node").agg(F.struct(*words).alias("parity"))


def _exactly(members: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links across components among all nodes of mixed buckets, candidates by their rarest shingles.

    Of two linked sets the smaller has a common shingle among its rarest |x| - 2p/(100+p) |x| + 1,
    the larger among its rarest |y| - p/100 |y| + 1, in one order of all shingles.
    """
    inside = cut(_mixed(members, roots).select("node", "root").distinct())
    if inside.isEmpty():
        return inside.select(F.col("node").alias("u"), F.col("root").alias("v")).limit(0)
    texts = _texts(inside.select("node"), nodes, docs)
    every = cut(_shingles(texts.dropDuplicates(["node"])).join(inside, "node"))
    several = every.groupBy("shingle").agg(F.count("*").alias("times"), F.min("root").alias("low"), F.max("root").alias("high"))
    several = several.select("shingle", "times", (F.col("low") < F.col("high")).alias("several"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("times", "shingle")).cast("long")
    sizes = nodes.select("node", F.col("n_shingles").alias("size")).join(_parities(every), "node")
    ranked = every.join(several, "shingle").withColumn("place", place).join(sizes, "node")
    need = lambda numerator, denominator: -F.floor(-F.col("size") * numerator / denominator)
    ranked = ranked.where(F.col("several") & (F.col("place") <= F.col("size") - need(percent, 100) + 1))
    ranked = ranked.withColumn("first", F.col("place") <= F.col("size") - need(2 * percent, 100 + percent) + 1)
    ranked = cut(ranked.select("shingle", "node", "root", "size", "place", "first", "parity"))
    both = ranked.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("first").alias("any")).where("low < high and any")
    ranked = ranked.join(both.select("shingle"), "shingle", "left_semi")
    x = ranked.where("first").select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("node", "root", "size", "place", "parity")])
    y = ranked.select("shingle", *[F.col(c).alias(f"{c}_y") for c in ("node", "root", "size", "place", "parity")])
    smaller = "(size_x < size_y or size_x = size_y and node_x < node_y)"
    reach = f"(1 + least(size_x - place_x, size_y - place_y)) * {100 + percent} >= {percent} * (size_x + size_y)"
    apart = " + ".join(f"bit_count(parity_x.p{i} ^ parity_y.p{i})" for i in range(PARITIES))
    bits = f"(size_x + size_y - ({apart})) * {100 + percent} >= {2 * percent} * (size_x + size_y)"
    pairs = x.join(y, "shingle").where(f"root_x != root_y and {smaller} and 100 * size_x >= {percent} * size_y and {reach} and {bits}")
    pairs = pairs.select(F.greatest("node_x", "node_y").alias("u"), F.least("node_x", "node_y").alias("v")).distinct()
    return decided(pairs, nodes, docs, percent)


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """`key`, mark (hash of the text), n_shingles, component_id and kept for each row; links from `percent` of similarity."""
    docs = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    rows = cut(profile(docs, percent))
    least = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "mark"))
    nodes = rows.where("digest is not null").groupBy("digest").agg(least.alias("m"), F.first("bands").alias("bands"), F.first("low").alias("low"), F.first("n_shingles").alias("n_shingles"))
    nodes = nodes.select("digest", "m.key", "m.mark", "bands", "low", "n_shingles", F.monotonically_increasing_id().alias("node"))
    nodes = cut(nodes)  # fixes the ids, which depend on how rows were dealt out
    shared = nodes.select(F.explode("bands").alias("bucket")).groupBy("bucket").count().where("count > 1").select("bucket")
    members = cut(nodes.select("node", F.explode("bands").alias("bucket")).join(shared, "bucket", "left_semi"))
    links, roots = _rounds(members, nodes, docs, percent)
    rest = _exactly(members, roots, nodes, docs, percent)
    if not rest.isEmpty():
        roots = components(links.unionByName(rest))
    ids = nodes.select("digest", "node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = ids.groupBy("root").agg(F.min("key").alias("component_id"))
    named = ids.join(named, "root").select("digest", "component_id")
    out = rows.select("key", "mark", "n_shingles", "digest").join(named, "digest", "left")
    out = out.select("key", "mark", "n_shingles", F.coalesce("component_id", "key").alias("component_id"))
    return out.select(F.col("key").alias(key), "mark", "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents")).drop("mark")


_ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
pair AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT u, v FROM pair UNION SELECT r.u, p.v FROM reach r JOIN pair p ON p.u = r.v),
root AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(v, doc_id)) AS component_id, doc_id <= coalesce(v, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root ON u = doc_id
"""

QUERIES, ORACLES = {"op8_neardup": op8_neardup}, {"op8_neardup": _ORACLE}

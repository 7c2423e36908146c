"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Two lines are near when at most `EDITS` insertions, deletions or substitutions of code points
turn one into the other. Lines linked by chains of near lines form a group; of each group only
the first line in order (key, then place in the text) stays, every other occurrence goes.

1. A line is cut into EDITS + 1 segments. Near lines share at least one segment: the shorter
   one's segment is a substring of the longer one near the same place. Each line is indexed
   under (length, segment number, segment) and probes, for each length that a near line may
   have, the substrings at places that the number of edits left and right of them allows.
2. In a bucket each probe is paired with the least indexed line, never with all. Where a
   bucket then still spans several groups, its lines are segmented more finely: a line is
   indexed under the rarest of its `GRAM`-character pieces with their places, one more than
   the edits can destroy, and the others probe all their pieces. Lines of one template that
   differ in a word then meet only those with the same piece there, and make a pair only where
   parity bits of their pairs of characters differ in as few places as the edits can change.
3. Common prefixes and suffixes are trimmed; what is left is compared by a banded bit-parallel
   edit distance: the cells on 2 * EDITS + 1 diagonals of a column are bits of one word, and a
   column takes a few operations on it.
4. Connected components of the links are the groups; equal lines are one node throughout.

Cases: lines end at line feeds; a blank line is never judged and always stays; a line of fewer
than `shortest` characters is near to equal lines only; a null text has no lines and stays
null; a document left with no text has kept "" (or null if it was null); a null key comes after
all others; rows that repeat key and text are one document; rows that share a key only are
ordered by a hash of the text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depotlane.llm.components import components
from depotlane.llm.tables import cut, read

EDITS = 2
#: Characters of the shortest lines that may be near without being equal.
SHORTEST = 24
#: Characters of a piece, and places that one key of a piece covers.
GRAM, PLACES = 3, 8
#: Words of 64 parity bits of a line, parts of a line that are looked for in another, lines in one task of the finer join, pairs in one that compares.
PARITIES, PARTS, LINES_IN_PART, PAIRS_IN_PART = 4, 8, 512, 2048
#: Rows of a few longs that may be broadcast, and removed lines (of 40 bytes at most, with their
#: rows) that may be broadcast to their texts; more are joined by shuffles.
BROADCAST_ROWS, BROADCAST_LINES = 500_000, 1_000_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _common(a: Column, b: Column, most: Column) -> Column:
    """Bytes of whole characters at the start of two UTF-8 strings that are equal, up to `most`, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(16, -1, -1)])
    fits = lambda p, w: (p + w <= most) & (F.substring(a, p + 1, w) == F.substring(b, p + 1, w))
    within = lambda p: F.substring(a, p + 1, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    whole = lambda p: F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), p, lambda q, _: q - F.when(within(q), 1).otherwise(0))
    return let(F.aggregate(steps, F.lit(0), lambda p, w: p + F.when(fits(p, w), w).otherwise(F.lit(0))), whole)


def near(long: Column, short: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most `edits`; `long` has as many characters as `short` or more."""
    n, m = F.octet_length(long), F.octet_length(short)
    chars = lambda s: F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))
    common = lambda a, b, most: let(a.cast("binary"), lambda x: let(b.cast("binary"), lambda y: _common(x, y, most)))

    def trimmed(before: Column, after: Column) -> Column:
        x, y = (F.substring(s.cast("binary"), before + 1, size - before - after).cast("string") for s, size in ((long, n), (short, m)))
        return let(F.struct(x.alias("x"), y.alias("y")), decided)

    def decided(s: Column) -> Column:
        # of two edits one is at either end of what is left, and what is between them is unchanged
        may = F.contains(s["y"], F.substring(s["x"], F.lit(2), F.length(s["x"]) - 2)) if edits == 2 else F.lit(True)
        return F.when(may, let(chars(s["x"]), lambda a: let(chars(s["y"]), lambda b: _near(a, b, edits)))).otherwise(F.lit(False))

    rest = lambda before: let(common(F.reverse(long), F.reverse(short), F.least(n, m) - before), lambda after: trimmed(before, after))
    return F.when(F.length(long) - F.length(short) > edits, F.lit(False)).otherwise(let(common(long, short, F.least(n, m)), rest))


def _near(long: Column, short: Column, edits: int) -> Column:
    """The same for arrays of characters.

    Bit t of a word stands for row j - edits + t of column j, rows being characters of `long`
    and columns of `short`. Known differences: `up` and `down` of a cell to the one above it.
    The distance is followed along the diagonal that ends in the last cell.
    """
    full, top = (1 << (2 * edits + 1)) - 1, 1 << (2 * edits)
    apart = F.size(long) - F.size(short)

    def column(state: Column, j: Column) -> Column:
        letter = F.get(short, j - 1)
        matches = sum((F.when(F.get(long, j - 1 + t - edits) == letter, F.lit(1 << t)).otherwise(F.lit(0)) for t in range(1, 2 * edits + 1)), F.when(F.get(long, j - 1 - edits) == letter, F.lit(1)).otherwise(F.lit(0)))
        aligned = F.struct(matches.alias("m"), F.shiftright(state["up"], 1).bitwiseOR(F.lit(top)).alias("up"), F.shiftright(state["down"], 1).alias("down"))

        def diagonal(x: Column) -> Column:
            carried = (x["m"].bitwiseAND(x["up"]) + x["up"]).bitwiseXOR(x["up"])
            same = carried.bitwiseOR(x["m"]).bitwiseOR(x["down"]).bitwiseAND(F.lit(full))
            return let(F.struct(same.alias("same"), x["up"].alias("up"), x["down"].alias("down")), horizontal)

        def horizontal(x: Column) -> Column:
            right = x["down"].bitwiseOR(F.bitwise_not(x["same"].bitwiseOR(x["up"])))
            left = x["same"].bitwiseAND(x["up"])
            moved = F.struct(x["same"].alias("same"), F.shiftleft(right, 1).bitwiseOR(F.lit(1)).alias("right"), F.shiftleft(left, 1).alias("left"))
            return let(moved, vertical)

        def vertical(x: Column) -> Column:
            up = x["left"].bitwiseOR(F.bitwise_not(x["same"].bitwiseOR(x["right"]))).bitwiseAND(F.lit(full))
            down = x["same"].bitwiseAND(x["right"]).bitwiseAND(F.lit(full))
            stays = F.call_function("shiftright", x["same"], apart + edits).bitwiseAND(F.lit(1))
            return F.struct(up.alias("up"), down.alias("down"), (state["d"] + 1 - stays).alias("d"))

        return let(aligned, diagonal)

    start = F.struct(F.lit(((1 << edits) - 1) << (edits + 1)).alias("up"), F.lit(0).alias("down"), apart.alias("d"))
    steps = F.when(F.size(short) > 0, F.sequence(F.lit(1), F.size(short))).otherwise(F.array().cast("array<int>"))
    distance = F.aggregate(steps, start, column, lambda s: s["d"])
    return F.when(apart > edits, F.lit(False)).otherwise(distance <= edits)


def _shifts(edits: int) -> list[tuple[int, int, int]]:
    """(less, number, shift): segments at which a line may meet one that is `less` characters shorter.

    With i segments before it, a segment can be off by i places at most, and by what the
    edits left after it can mend. (0, i, 0) are the line's own segments, under which it is indexed.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            out += [(less, i, shift) for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)]
    return out


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """id, bucket and indexed of each probe of the lines (id, line). Later segments may be longer by one character.

    One row a shift, then one expression: an expression for each shift would be too long to be compiled well.
    """
    spec = F.array(*[F.struct(F.lit(a).alias("less"), F.lit(i).alias("number"), F.lit(b).alias("shift")) for a, i, b in _shifts(edits)])
    plain = F.octet_length("line") == F.length("line")  # bytes are characters, and parts of bytes are found at once
    rows = lines.select("id", "line", plain.alias("plain"), F.length("line").alias("n"), F.explode(spec).alias("s"))
    rows = rows.select("id", "line", "plain", (F.col("n") - F.col("s.less")).alias("n"), "s")
    parts = edits + 1
    base, rest, number = F.floor(F.col("n") / parts).cast("int"), F.col("n") % parts, F.col("s.number")
    start = base * number + F.greatest(F.lit(0), number - parts + rest) + F.col("s.shift")
    size = base + (number >= F.lit(parts) - rest).cast("int")
    indexed = (F.col("s.less") == 0) & (F.col("s.shift") == 0)
    part = F.when(F.col("plain"), F.substring(F.col("line").cast("binary"), start + 1, size)).otherwise(F.substring("line", start + 1, size).cast("binary"))
    return rows.select("id", F.xxhash64("n", number, part).alias("bucket"), indexed.alias("indexed"))


def _lines(docs: DataFrame) -> DataFrame:
    """row, place, line of each judged line, with two 64-bit hashes of the line."""
    out = docs.select("row", F.posexplode(F.split("text", "\n")).alias("place", "line")).where(F.trim("line") != "")
    return out.withColumns({"id": F.xxhash64("line"), "id2": F.xxhash64(F.lit(29), "line")})


def _few(df: DataFrame) -> DataFrame:
    """`df`, written, and broadcast where it is small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _intact(long: Column, short: Column, edits: int) -> Column:
    """Whether all but `edits` of some parts of the shorter line lie in the longer one near the same places."""
    n, found = F.length(short), []
    for i in range(PARTS):
        start, end = F.floor(n * i / PARTS).cast("int"), F.floor(n * (i + 1) / PARTS).cast("int")
        begin = F.greatest(start - edits, F.lit(0))
        found.append(F.contains(F.substring(long, begin + 1, end + edits - begin), F.substring(short, start + 1, end - start)).cast("int"))
    return sum(found, F.lit(0)) >= PARTS - edits


def _confirmed(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The near ones of distinct pairs (u, v) of line ids; texts: id, line."""
    pairs = cut(pairs)
    both = pairs.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v")
    longer = F.length("a") >= F.length("b")
    both = both.select("u", "v", F.when(longer, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(longer, F.col("b")).otherwise(F.col("a")).alias("y"))
    both = both.repartition(1 + pairs.count() // PAIRS_IN_PART).where(_intact(F.col("x"), F.col("y"), edits))
    return cut(both.where(near(F.col("x"), F.col("y"), edits)).select("u", "v").distinct())


def _pieces(lines: DataFrame) -> DataFrame:
    """id, root, n and hashes of all runs of GRAM (grams) and of two (pairs) characters of each line (id, root, line)."""

    def runs(chars: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - size), lambda at: F.hash(*[F.get(chars, at + k) for k in range(size)]))

    # characters are taken from an array: substrings would read the line from its start each
    both = let(F.split("line", ""), lambda c: F.struct(runs(c, GRAM).alias("grams"), runs(c, 2).alias("pairs")))
    return lines.select("id", "root", F.length("line").alias("n"), both.alias("b")).select("id", "root", "n", "b.grams", "b.pairs")


def _met(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs (u, v) of lines (id, root, line) of different roots that may be near.

    An edit destroys GRAM pieces of that many characters, so of any edits * GRAM + 1 pieces of a line one is found,
    shifted by `edits` at most, in every line near to it: its rarest ones are indexed. Parities
    are bits that tell whether an odd number of a line's pairs of characters falls on them; an
    edit changes four bits at most.
    """
    parts = 1 + lines.count() // LINES_IN_PART
    lines = cut(_pieces(lines.repartition(parts)))
    place = lambda at: F.floor(at / PLACES)
    whole = lines.select("id", "root", "n", F.posexplode("grams").alias("at", "gram"))
    own = whole.select("id", "at", F.xxhash64("gram", place(F.col("at"))).alias("key"))
    times = _few(own.groupBy("key").agg(F.count("*").alias("times")))
    rarest = F.slice(F.sort_array(F.collect_list(F.shiftleft("times", 32) + F.col("at"))), 1, edits * GRAM + 1)
    index = own.join(times, "key").groupBy("id").agg(rarest.alias("rarest")).select("id", F.explode("rarest").alias("r"))
    hashed = lines.select("id", F.explode("pairs").alias("h"))
    bits = hashed.select("id", F.pmod("h", F.lit(PARITIES)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("h", 8), F.lit(64))).alias("bit"))
    words = [F.coalesce(F.bit_xor(F.when(F.col("word") == i, F.col("bit"))), F.lit(0).cast("long")).alias(f"p{i}") for i in range(PARITIES)]
    parity = _few(bits.groupBy("id").agg(F.struct(*words).alias("parity")))
    index = index.select("id", F.pmod("r", F.lit(1 << 32)).cast("int").alias("at")).join(lines.join(parity, "id"), "id")
    index = _few(index.select("id", "root", "n", "at", "parity", F.xxhash64(F.get("grams", F.col("at")), place(F.col("at"))).alias("key")))
    near_places = F.array_distinct(F.array(place(F.col("at") - edits), place(F.col("at") + edits)))
    probes = whole.select("id", "root", "n", "at", "gram", F.explode(near_places).alias("p")).select("id", "root", "n", "at", F.xxhash64("gram", "p").alias("key"))
    side = lambda df, name: df.select("key", *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "key"])
    met = side(probes, "y").join(parity.select(F.col("id").alias("id_y"), F.col("parity").alias("parity_y")), "id_y").join(side(index, "x"), "key")
    apart = " + ".join(f"bit_count(parity_x.p{i} ^ parity_y.p{i})" for i in range(PARITIES))
    met = met.where(f"root_x != root_y and abs(n_x - n_y) <= {edits} and abs(at_x - at_y) <= {edits} and {apart} <= {4 * edits}")
    return met.select(F.greatest("id_x", "id_y").alias("u"), F.least("id_x", "id_y").alias("v")).distinct()


def line_groups(lines: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(node, root) of the line ids that are near another line, by groups; lines: id, line."""
    if shortest < (edits + 1) * GRAM:
        raise ValueError(f"lines that are near by {edits} edits need {(edits + 1) * GRAM} characters or more")
    lines = lines.select("id", "line").where(F.length("line") >= shortest)
    keys = _keys(lines, edits)
    own = F.when(F.col("indexed"), F.col("id"))
    live = keys.groupBy("bucket").agg(F.min(own).alias("v"), F.max(own).alias("top"), F.min("id").alias("low"), F.max("id").alias("high"))
    live = _few(live.where("v is not null and low < high").select("bucket", "v", "top"))
    members = cut(keys.join(live, "bucket").select("id", "bucket", "v", (F.col("top") > F.col("v")).alias("several")).distinct())
    wanted = _few(members.select("id").distinct())
    texts = cut(lines.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line")))
    pair = (F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v"))
    links = _confirmed(members.where("id != v").select(*pair).distinct(), texts, edits)
    roots = components(links)
    # buckets of several indexed lines that still span groups
    placed = members.where("several").select("id", "bucket").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "bucket", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    hot = cut(placed.join(mixed, "bucket").select("id", "root").distinct().join(texts, "id"))
    if hot.isEmpty():
        return roots
    met = _met(hot, edits).join(links, ["u", "v"], "left_anti")
    return components(links.unionByName(_confirmed(met, texts, edits)))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, rest: str | None = None, shortest: int = SHORTEST) -> DataFrame:
    """`key`, text, n_lines, n_removed and kept (the text without removed lines) for each row, with column `rest` if one is named."""
    carried = [docs[rest].alias("rest")] if rest else []
    own = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"), *carried)
    unique = own.groupBy("key").count().where("count > 1").isEmpty()
    mark = F.lit(0).cast("long") if unique else F.xxhash64("text")
    own = own.select(F.struct(F.col("key").isNull().alias("absent"), "key", mark.alias("mark")).alias("row"), "text", *(["rest"] if rest else []))
    lines = _lines(own)
    repeats = cut(lines.groupBy("id", "id2").count().where("count > 1").select("id", "id2"))
    roots = cut(line_groups(lines, edits, shortest))
    # occurrences of lines that repeat or are near others; all other lines stay
    found = _few(repeats.select("id").unionByName(roots.select(F.col("node").alias("id"))).distinct())
    lines = cut(lines.join(found, "id", "left_semi").select("row", "place", "id", "id2"))
    classes = lines.groupBy("id", "id2").agg(F.min(F.struct("row", "place")).alias("first"))
    classes = cut(classes.join(roots.withColumnRenamed("node", "id"), "id", "left"))
    heads = classes.where("root is not null").groupBy("root").agg(F.min("first").alias("head"))
    stays = classes.join(heads, "root", "left").select("id", "id2", F.coalesce("head", "first").alias("stays"))
    gone = lines.join(stays, ["id", "id2"]).where("struct(row, place) != stays")
    gone = cut(gone.groupBy("row").agg(F.collect_set("place").alias("gone")))
    n_gone = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    gone = F.broadcast(gone) if n_gone <= BROADCAST_LINES else gone
    out = own.join(gone, "row", "left").withColumn("lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return out.select(F.col("row.key").alias(key), F.col("text").alias(text), n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"), *([F.col("rest").alias(rest)] if rest else []))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (lowercase hex of the kept text, UTF-8; null: empty)."""
    out = dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


# No SQL: comparing all pairs of lines there is too slow; a test holds the query against brute force.
QUERIES, ORACLES = {"op6_lines": op6_lines}, {}

"""Personal data by generators of spans and boosted trees, in DataFrame functions alone.

Base spans (e-mail addresses, IP addresses, card and phone numbers) follow fixed patterns and
checks and always stay. Broader generators propose further, overlapping spans: numbers in
groups, long card numbers, addresses spelled with "at" and "dot", and long strings that may be
secrets. Gradient-boosted trees score these from features of format and context.

Nobody labelled spans, so labels come from what the features don't see:
- a base span is positive if its check holds, else negative; features are taken from a normal
  form without the phone prefix, the "@" or its spelling, and the separators of a card, and the check
  digit of cards is no feature;
- a proposal that overlaps a valid base span of another kind is negative;
- the word before an e-mail address, put in place of its local part, is negative ("meet at host");
- a long string is positive where it is assigned in quotes (`name = "..."`), else negative; its
  context is no feature. So where strings of the same format often stand bare (digests of files, say),
  the kind fails its precision and adds nothing.

At most about `SHOWN` examples of each kind and label, by hash, train the trees. The documents of a quarter
of all texts (by hash, so that copies stay together) are held back, and all of them set the thresholds: for
each kind the least score from which `PRECISION` of the held-back spans are positive. A kind of
which fewer than `LEAST_SHOWN` held-back spans reach any such score adds nothing. A proposal that
overlaps a base span goes; of proposals that overlap each other, the one of the higher score stays.

The trees become one expression, so that finding, scoring and selecting happen in one pass over
the texts, without shuffles. Patterns use possessive repeats and look-behinds that find what
the plain patterns find, in time linear in the text and without recursion.

Cases: null and empty texts have no spans; a null key is an ordinary row; repeated rows are
found each; without both kinds of examples only base spans are returned; an empty table gives
an empty table; other columns are ignored. Places count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depotlane.llm.tables import cut, read, text_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans: base kinds, and one that only the trees add.
ALL = (*KINDS, "secret")
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kind and pattern of the further generators.
WIDER = (
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[{LABEL}]++(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[{LABEL}]++)++"),
    ("phone", r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,5}){1,5}+(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{3,4}){2,4}+(?![0-9])"),
    ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,200}+=?+=?+(?![A-Za-z0-9+/_-])"),
)
#: What a text must have for a further generator to be worth trying.
WORTH = {"email": r"(?:\x20at\x20|[\[(]at[\])])", "phone": "[0-9]{2}", "card": "[0-9]{3}", "secret": "[A-Za-z0-9+/_-]{16}"}
CONTEXT = r"(?i)(?:tel|phone|call|fax|mobile|card|visa|account|mail|contact|write|host|server|address)[^\n]{0,12}$"
ASSIGNED = r"[A-Za-z0-9_-]\x20?[:=]\x20?[\x22']$"

SHOWN = 2000
PRECISION, LEAST_SHOWN = 0.98, 20
TREES, DEPTH = 12, 4
#: Tasks of each training step: the sample is bounded, and the steps are many.
TASKS = 4


def found(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and non-overlapping: array of (a, b, m), code points."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(pieces.alias("p"), matches.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,m:string>>").alias("out"))

    def add(state: Column, pair: Column) -> Column:
        a = state["at"] + F.length(pair["p"])
        b = a + F.length(pair["m"])
        return F.struct(b.alias("at"), F.concat(state["out"], F.array(F.struct(a.alias("a"), b.alias("b"), pair["m"].alias("m")))).alias("out"))

    return F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), start, add, lambda s: s["out"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a string pass the check of card numbers."""
    d = digits(m)
    n = F.length(d)

    def worth(i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The check of a span."""
    if kind in ("email", "secret"):
        return F.lit(True)
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}$")
    n = F.length(digits(m))
    return n.between(10, 15) if kind == "phone" else F.when(n.between(14, 19), luhn(m)).otherwise(False)


def _candidate(kind: str, base: bool) -> Callable[[Column], Column]:
    number = F.lit(ALL.index(kind))
    return lambda s: F.struct(number.alias("kind"), s["a"].alias("a"), s["b"].alias("b"), s["m"].alias("m"), F.lit(base).alias("base"), valid(kind, s["m"]).alias("ok"))


def candidates(text: str) -> Column:
    """All spans that generators propose: kind (index), a, b, m, base (of a base pattern), ok (its check)."""
    body, parts = F.col(text), []
    none = F.array().cast("array<struct<kind:int,a:int,b:int,m:string,base:boolean,ok:boolean>>")
    may = {"email": F.contains(body, F.lit("@")), "ip": body.rlike("[0-9][.][0-9]"), "card": body.rlike("[0-9]"), "phone": F.contains(body, F.lit("+"))}
    for base, kind, pattern in [*((True, k, p) for k, p in BASE.items()), *((False, k, p) for k, p in WIDER)]:
        here = may[kind] if base else body.rlike(WORTH[kind])
        parts.append(F.when(here, F.transform(found(body, pattern), _candidate(kind, base))).otherwise(none))
    return F.concat(*parts)


#: Feature names; each is a number of a candidate and its surroundings.
FEATURES = ("kind", "chars", "digits", "runs", "gaps", "parens", "first", "last", "lead", "letters", "vowels", "dots", "local", "local_digits", "before", "after", "words")


def normal(kind: Column, m: Column) -> Column:
    """A span in a form in which plain and wider patterns of its kind agree."""
    email = F.regexp_replace(F.regexp_replace(m, r"\x20?[\[(]at[\])]\x20?|\x20at\x20", "@"), r"\x20?[\[(]dot[\])]\x20?|\x20dot\x20", ".")
    return (
        F.when(kind == KINDS.index("email"), email).when(kind == KINDS.index("card"), digits(m))
        .when(kind == KINDS.index("phone"), F.regexp_replace(m, r"^\+[0-9]{1,2}[\x20-]", "")).otherwise(m)
    )


def featured(text: str, spans: str) -> Column:
    """The candidates with their features as fields, and whether they stand in an assignment."""
    body = F.col(text)

    def one(c: Column) -> Column:
        m = normal(c["kind"], c["m"])
        near = F.substring(body, F.greatest(c["a"] - 23, F.lit(1)), F.least(c["a"], F.lit(24)))
        after = F.substring(body, c["b"] + 1, F.lit(1))
        plain = c["kind"] != ALL.index("secret")  # the context of long strings is their label
        count = lambda x, pattern: F.length(F.regexp_replace(x, pattern, ""))
        local = F.regexp_extract(m, "^([^@]*)@", 1)
        values = {
            "kind": c["kind"], "chars": F.length(m), "digits": F.length(digits(m)), "runs": F.size(F.split(m, "[^0-9]+")),
            "gaps": count(m, r"[^\x20.-]"), "parens": count(m, "[^()]"), "first": F.length(F.regexp_extract(m, "^[(]?([0-9]*)", 1)),
            "last": F.length(F.regexp_extract(m, "([0-9]*)$", 1)), "lead": F.coalesce(F.try_to_number(F.regexp_extract(m, "([0-9])", 1), F.lit("9")).cast("int"), F.lit(-1)),
            "letters": count(m, "[^A-Za-z]"), "vowels": count(m, "[^AEIOUaeiou]"), "dots": count(m, "[^.]"), "local": F.length(local), "local_digits": F.length(digits(local)),
            "before": (plain & near.rlike("[0-9A-Za-z]$")).cast("int"), "after": (plain & after.rlike("^[0-9A-Za-z]")).cast("int"), "words": (plain & near.rlike(CONTEXT)).cast("int"),
        }
        told = near.rlike(ASSIGNED) & after.rlike("^[\x22']")
        return F.struct(*[c[n].alias(n) for n in ("a", "b", "m", "base", "ok")], c["kind"].alias("k"), told.alias("told"), *[values[n].cast("double").alias(n) for n in FEATURES])

    return F.transform(spans, one)


def _overlap(x: Column, y: Column) -> Column:
    return (x["a"] < y["b"]) & (y["a"] < x["b"])


def examples(docs: DataFrame) -> DataFrame:
    """Labelled candidates of all texts: y, k, the features, h (hash of the example), held; docs: text."""
    email, secret = KINDS.index("email"), ALL.index("secret")
    found_in = docs.select("text", candidates("text").alias("c"))
    out = found_in.withColumn("base", F.filter("c", lambda c: c["base"] & c["ok"]))
    lure = lambda c: F.struct(
        c["kind"].alias("kind"), c["a"].alias("a"), c["b"].alias("b"),
        F.concat(F.regexp_extract(F.substring(F.col("text"), F.greatest(c["a"] - 40, F.lit(1)), F.least(c["a"], F.lit(41))), r"([^\s@]+)\s+\S*$", 1), F.regexp_extract(c["m"], "@.*$", 0)).alias("m"),
        F.lit(True).alias("base"), F.lit(False).alias("ok"),
    )
    lures = F.filter(F.transform(F.filter("base", lambda c: c["kind"] == email), lure), lambda c: ~c["m"].startswith("@"))
    kept = F.filter("c", lambda c: c["base"] | (c["kind"] == secret) | F.exists("base", lambda b: (b["kind"] != c["kind"]) & _overlap(b, c)))
    out = out.withColumn("all", F.concat(kept, lures)).withColumn("all", featured("text", "all"))
    out = out.select(F.xxhash64("text", F.lit(6)).alias("d"), F.posexplode_outer("all").alias("i", "e")).where("i is not null").select("d", "i", "e.*")  # not outer: the array would be built twice
    y = F.when(F.col("k") == secret, F.col("told")).otherwise(F.col("base") & F.col("ok")).cast("double")
    return out.select(y.alias("y"), "k", *FEATURES, F.xxhash64("d", "i").alias("h"), (F.pmod("d", F.lit(4)) == 0).alias("held"))


def _tree(node, fields: Callable[[str], Column]) -> Column:
    """A tree of the fitted model as an expression over the features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(fields(FEATURES[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild(), fields)).otherwise(_tree(node.rightChild(), fields))


def fit(docs: DataFrame) -> tuple[Callable[[Column], Column], list[float]] | None:
    """Score (0 to 1) of a featured candidate and the threshold of each kind; docs: text."""
    shown = cut(examples(docs))
    counts = shown.where("not held").groupBy("k", "y").count().collect()  # at most ten rows
    if len({r.y for r in counts}) < 2:
        return None
    share = F.lit(0)
    for r in counts:
        share = F.when((F.col("k") == r.k) & (F.col("y") == r.y), min(1 << 20, (SHOWN << 20) // r["count"])).otherwise(share)
    sample = cut(shown.where(~F.col("held") & (F.pmod("h", F.lit(1 << 20)) < share)).select("y", *FEATURES)).coalesce(TASKS)
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(sample)
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(train)
    trees, weights = list(model._java_obj.trees()), list(model.treeWeights)

    def score(c) -> Column:
        margin = sum((F.lit(2 * w) * _tree(t.rootNode(), lambda n: c[n]) for t, w in zip(trees, weights, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    held = shown.where("held").select("k", "y", F.round(score({n: F.col(n) for n in FEATURES}), 3).alias("p"))
    rows = held.groupBy("k", "p").agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()  # at most 5 * 1001 rows
    thresholds = []
    for k in range(len(ALL)):
        good = n = 0
        best = 2.0
        for r in sorted((r for r in rows if r.k == k), key=lambda r: -r.p):
            good, n = good + r.good, n + r.n
            if n >= LEAST_SHOWN and good >= PRECISION * n and r.p > 0.5:
                best = r.p
        thresholds.append(best)
    return score, thresholds


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, base and spans: arrays of (a, kind, b) in order, base spans alone and all spans."""
    own = docs.select(docs[key].alias("key"), text_of(text).alias("text"))
    fitted = fit(own.select("text"))
    own = own.withColumn("c", candidates("text"))
    shape = lambda c: F.struct(c["a"].alias("a"), c["kind"].alias("kind"), c["b"].alias("b"))
    base = F.transform(F.filter("c", lambda c: c["base"] & c["ok"]), shape)
    own = own.withColumn("base", F.array_sort(base))
    if fitted is None:
        return own.select(F.col("key").alias(key), "base", F.col("base").alias("spans"))
    score, thresholds = fitted
    free = F.filter("c", lambda c: ~c["base"] & c["ok"] & ~F.exists("base", lambda b: _overlap(b, c)))
    own = own.withColumn("more", free).withColumn("more", featured("text", "more"))
    limit = F.array(*[F.lit(float(t)) for t in thresholds])
    scored = F.transform("more", lambda c: F.struct(c["a"].alias("a"), c["k"].alias("kind"), c["b"].alias("b"), F.round(score(c), 3).alias("p")))
    own = own.withColumn("more", F.array_sort(F.filter(scored, lambda c: c["p"] >= F.get(limit, c["kind"]))))
    picked = F.transform(_best("more"), shape)
    return own.select(F.col("key").alias(key), "base", F.array_sort(F.concat("base", picked)).alias("spans"))


def _best(scored: str) -> Column:
    """Of spans in order, those that overlap no kept span before them, or outscore it and take its place."""
    none = F.array().cast("array<struct<a:int,kind:int,b:int,p:double>>")

    def add(out: Column, c: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        clash = last.isNotNull() & (c["a"] < last["b"])
        return F.when(~clash, F.concat(out, F.array(c))).when(c["p"] > last["p"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(c))).otherwise(out)

    return F.aggregate(scored, none, add)


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in ALL])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["a"].cast("string"), s["b"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES, ORACLES = {"op10_pii": op10_pii}, {}

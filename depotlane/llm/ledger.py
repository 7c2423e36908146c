"""Secrets by an incremental ledger of scanned blobs.

A blob is the content of any version of any path, named by its SHA-256. The ledger has rows of a blob, the
rules that were applied to it, each named with its version, and what they found. A scan groups the versions given
by blob, takes from the ledger which rules each blob still lacks, applies only those, and returns the rows to append;
a report joins findings back to every path and version that holds the blob. So copies and old
versions are scanned once, a new rule visits old blobs for itself alone, and a changed rule, whose
version is a checksum of what it says, is a new rule.

Copies meet in Spark's partial aggregation before the shuffle, so that a text held by a third of all rows
sends one row from each task. The ledger is one folder of Parquet that scans append to (`extend`);
rows written twice after a lost driver do no harm, as rules and findings are taken as sets.

Base rules follow fixed patterns and checks. The ledger adds rules of further fixed formats (private
key blocks, prefixed access tokens); base spans always stay.

Cases: a null text is an empty blob, without findings; null keys and repeated rows are rows like
others; long texts are searched whole, in time linear in their length; an empty table gives an
empty ledger and report; other columns are not read. Places count code points, ends are exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depotlane.llm.tables import cut, read, slices, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches that don't overlap, dropped if `group` has fewer than `least` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    @property
    def name(self) -> str:
        """The kind with the version, a checksum of all that decides."""
        return f"{self.kind}@{zlib.crc32(repr((self.pattern, self.least, self.group)).encode()):08x}"

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern)


def either(word: str) -> str:
    """A pattern for a word of ASCII letters in either case, and for those letters alone."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGNED = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", rf"({ASSIGNED})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
FURTHER = (
    Rule("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("prefixed", r"(?:gh[pousr]_|github_pat_|xox[abprs]-|glpat-)[A-Za-z0-9_-]+", 24),
)
RULES = BASE + FURTHER

#: Bytes of text that a worker searches at a time (a longer text is one slice).
SLICE = 1_000_000
LEDGER = "blob string, rules array<string>, found array<struct<rule:string,start:int,end:int>>"
_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def blob(text: str) -> Column:
    """The name of a content."""
    return F.sha2(text_of(text).cast("binary"), 256)


def missing(versions: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """(blob, text, rules): every content once, with the rules that the ledger doesn't have for it; none without any."""
    names = F.array(*[F.lit(r.name) for r in rules]).cast("array<string>")
    contents = versions.select(blob(text).alias("blob"), text_of(text).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return contents.select("blob", "text", names.alias("rules"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    left = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
    return contents.join(seen, "blob", "left").select("blob", "text", left.alias("rules")).where(F.size("rules") > 0)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Rows to append to the ledger: what the missing rules find in each blob."""
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {name: r.compiled() for name, r in by_name.items()}
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            found = []
            for content, names in zip(batch.column(1), batch.column(2).to_pylist()):
                content, spans = content.as_py(), []
                for name in names:
                    rule = by_name[name]
                    spans += [{"rule": name, "start": m.start(), "end": m.end()} for m in patterns[name].finditer(content) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                found.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, _FOUND)], ["blob", "rules", "found"])

    return missing(versions, ledger, rules, text).mapInArrow(run, LEDGER)


def report(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and found: array of (start, kind, end), by start and the rules' order, of each version.

    `kind` is the place of the rule among `rules`; findings of other rules and versions are left out.
    """
    names = F.array(*[F.lit(r.name) for r in rules]).cast("array<string>")
    span = lambda s: F.struct(s["start"].alias("start"), (F.array_position(names, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end"))
    none = "array<struct<start:int,kind:int,end:int>>"
    mine = ledger.select("blob", F.transform(F.filter("found", lambda s: F.array_contains(names, s["rule"])), span).cast(none).alias("found")).where(F.size("found") > 0)
    findings = mine.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    paths = versions.select(versions[key].alias("key"), blob(text).alias("blob"))
    return paths.join(findings, "blob", "left").select(F.col("key").alias(key), F.coalesce("found", F.array().cast(none)).alias("found"))


def extend(spark: SparkSession, versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Scans what the ledger in `folder` lacks, appends it there and returns the whole ledger.

    The folder must be one that all executors share. A scan that fails appends nothing.
    """
    try:
        ledger = spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        ledger = None
    scan(versions, ledger, rules, text).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def joined(found: Column, rules: Sequence[Rule]) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = report(docs, cut(scan(docs)))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return out.select("doc_id", *counts, F.sha2(joined(base, RULES), 256).alias("base_sha256"), joined(F.col("found"), RULES).alias("spans"))


def oracle() -> str:
    """SQL for the same rows: places from the lengths of matches and of the pieces between them."""
    def spans(i: int, rule: Rule) -> str:
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        length = f"length(regexp_extract(x, {pattern}, {rule.group}))"
        return f"""SELECT doc, a AS start, {i} AS kind, a + length(x) AS stop FROM (
  SELECT doc, m[k] AS x, list_sum(list_transform(p[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda y: length(y))), 0) AS a
  FROM (SELECT doc, p, m, unnest(range(1, len(m) + 1)) AS k FROM (
    SELECT doc, string_split_regex(text, {pattern}) AS p, regexp_extract_all(text, {pattern}) AS m FROM docs WHERE regexp_matches(text, {pattern}))))
WHERE {length} >= {rule.least}"""

    parts = "\nUNION ALL ".join(spans(i, r) for i, r in enumerate(RULES))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    one = f"{kinds}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
found AS (SELECT doc, {counts}, string_agg({one}, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg({one}, ',' ORDER BY start, kind) AS spans
FROM ({parts}) GROUP BY doc)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (doc)"""


QUERIES, ORACLES = {"op11_ledger": op11_ledger}, {"op11_ledger": oracle()}

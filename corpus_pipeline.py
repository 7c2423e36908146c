"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes the documents that its predecessor kept and returns the columns of documents,
but for the last, which returns tokens. A stage can be lost and run again by itself: `run`
writes each result to the checkpoint folder before the next stage reads it.

Cases, in every stage: a null or empty text is a document like others (it is judged by its
score, has no lines, shingles or contamination, and no tokens); rows without a doc_id are
kept or dropped by their text; repeated rows fall to near-dedup, which keeps one; an empty
table gives an empty table; further columns of the documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from depotlane.llm import bpe, contamination, lines, neardup, quality
from depotlane.llm.tables import cut, read


#: Near-dedup here links from a similarity of 0.80 (of sets of five-word shingles).
PERCENT = 80


def _nested(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all columns but the text in one, whose names then can't clash."""
    return docs.select("doc_id", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest"), docs["text"].cast("string").alias("text"))


def _flat(nested: DataFrame, columns: list[str]) -> DataFrame:
    return nested.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.fit(docs, read(spark, sf_dir, "labels"))(_nested(docs))
    return _flat(scored.where(F.col("score") >= quality.GOOD_FROM), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur, or nearly occur, earlier; those left without any text go."""
    out = lines.dedup(_nested(docs), rest="rest")
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept", r"\s+", " ")) != ""))
    kept = _flat(out.select("rest", F.col("kept").alias("text")), docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates."""
    linked = cut(neardup.link(docs, percent=PERCENT))
    gone = linked.where("not kept").select(F.struct("doc_id", "mark").alias("row")).distinct()
    row = F.struct("doc_id", F.xxhash64("text").alias("mark"))
    out = _nested(docs).select(row.alias("row"), "rest", "text").join(gone, "row", "left_anti")
    twice = cut(linked.where("kept and n_shingles > 0").groupBy(F.struct("doc_id", "mark").alias("row")).count().where("count > 1").select("row"))
    if not twice.isEmpty():  # rows that repeat a doc_id and its text, which has words: one of them stays
        out = out.join(twice, "row", "left_anti").unionByName(out.join(twice, "row", "left_semi").dropDuplicates(["row"]))
    return _flat(out, docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much of any benchmark item."""
    out = contamination.contamination(_nested(docs), read(spark, sf_dir, "benchmark"), key="rest")
    return _flat(out.where("not contaminated"), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them."""
    return bpe.encode(docs, bpe.vocabulary_path(), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokens),
]

#: No SQL: the classifier and the tokenizer can't be written as SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

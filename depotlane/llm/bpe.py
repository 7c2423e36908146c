"""Byte-level BPE: encoding by a queue of merge ranks, decoding by vocabulary strings.

A piece of text becomes a doubly linked list of symbols. A priority queue holds the rank of
every adjacent pair that the vocabulary can merge; the lowest rank is merged first, and an
entry whose symbols have changed meanwhile is stale and skipped. Decoding concatenates the
vocabulary strings of the ids.

Cases: a null or empty text has no ids; other columns of the input are not read, so their
names can't clash; repeated rows and ids give repeated rows; a null id stays null; an empty
table gives an empty table. A text of any length is encoded whole, one piece at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from depotlane.llm.tables import read, slices

#: How byte-level vocabularies cut text into pieces before merging, for given
#: classes of white space, letters and numbers.
SHAPES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: The classes by Unicode property, and the same classes below U+0180 listed for the plain matcher.
ANY = {"S": r"\p{White_Space}", "L": r"\p{L}", "N": r"\p{N}"}
LATIN = {"S": r"\t-\r\x20\x85\xa0", "L": r"A-Za-zªµºÀ-ÖØ-öø-ſ", "N": r"0-9²³¹¼-¾"}
BEYOND_LATIN = re.compile(r"[^\x00-\u017f]")

#: Pieces of at most LONG characters whose ids a worker remembers (some 20 MB); beyond it the memory starts anew.
REMEMBERED, LONG = 100_000, 40
#: Bytes of text that a worker encodes at a time (a longer text is one slice).
SLICE = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next free one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        ids = stored["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in stored.get("added_tokens", ())}
        self.strings = [b""] * (1 + max(*ids.values(), *self.special.values(), 0))
        for word, i in ids.items():
            self.strings[i] = bytes(letters[c] for c in word)
        for text, i in self.special.items():
            self.strings[i] = text.encode()
        self.bytes = [ids[letter] for letter in byte_letters()]
        self.merges = {}
        for rank, (left, right) in enumerate(stored["model"]["merges"]):
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])


def merge(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one piece."""
    merges = vocabulary.merges
    symbols = [vocabulary.bytes[b] for b in piece]
    end = len(symbols)
    before, after = list(range(-1, end - 1)), list(range(1, end + 1))
    queue = []
    for at in range(end - 1):
        if found := merges.get((symbols[at], symbols[at + 1])):
            queue.append((found[0], at, found[1], symbols[at], symbols[at + 1]))
    heapq.heapify(queue)
    while queue:
        _, at, merged, left, right = heapq.heappop(queue)
        follower = after[at]
        if symbols[at] != left or follower >= end or symbols[follower] != right:
            continue  # stale: a merge took one of the two symbols
        symbols[at], symbols[follower] = merged, -1
        after[at] = follower = after[follower]
        if follower < end:
            before[follower] = at
            if found := merges.get((merged, symbols[follower])):
                heapq.heappush(queue, (found[0], at, found[1], merged, symbols[follower]))
        if (leader := before[at]) >= 0 and (found := merges.get((symbols[leader], merged))):
            heapq.heappush(queue, (found[0], leader, found[1], symbols[leader], merged))
    return [s for s in symbols if s >= 0]


class Encoder:
    """Encodes whole texts to packed ids (little-endian unsigned 32-bit) and decodes them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(SHAPES.format(**ANY))
        self.latin = re.compile(SHAPES.format(**LATIN))
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special)) or r"(?!)")
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        packed, at = [], 0
        for special in self.special.finditer(text):
            packed += self.plain(text[at : special.start()])
            packed.append(self.vocabulary.special[special[0]].to_bytes(4, "little"))
            at = special.end()
        packed += self.plain(text[at:])
        return b"".join(packed)

    def plain(self, text: str) -> list[bytes]:
        pieces = (self.pieces if BEYOND_LATIN.search(text) else self.latin).findall(text)
        known, long = self.known, {}
        if len(known) > REMEMBERED:
            known.clear()
        for piece in {p for p in pieces if p not in known}:
            (known if len(piece) <= LONG else long)[piece] = array("I", merge(piece.encode(), self.vocabulary)).tobytes()
        return [known.get(p) or long[p] for p in pieces] if long else list(map(known.__getitem__, pieces))

    def decode(self, packed: bytes) -> str:
        ids = array("I", packed)
        return b"".join(map(self.vocabulary.strings.__getitem__, ids)).decode(errors="replace")


#: The encoder of this worker process, which later tasks use again.
_OWN: dict[str, Encoder] = {}


def own_encoder(path: str, held) -> Encoder:
    """The encoder of a broadcast vocabulary, made once in each worker process for its path."""
    if path not in _OWN:
        _OWN.clear()
        _OWN[path] = Encoder(held.value)
    return _OWN[path]


#: What `encode` can return of a text: name, Spark's type, Arrow's type and the value from packed ids and decoded text.
OUTPUTS = {
    "n_tokens": ("long", pa.int64(), lambda packed, text: len(packed) // 4),
    "ids": ("binary", pa.binary(), lambda packed, text: packed),
    "decoded": ("string", pa.string(), lambda packed, text: text),
    "ids_sha256": ("string", pa.string(), lambda packed, text: hashlib.sha256(packed).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda packed, text: hashlib.sha256(text.encode()).hexdigest()),
}


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """`key` and the named OUTPUTS for each row: ids are packed as little-endian unsigned 32-bit, digests are lowercase hex.

    A worker encodes some SLICE bytes of text at a time, so that it holds little beside the vocabulary.
    """
    held = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    makers = [OUTPUTS[name] for name in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = own_encoder(path, held)
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            columns = [[] for _ in makers]
            for t in batch.column(1):
                packed = encoder(t.as_py()) if t.is_valid else b""
                decoded = encoder.decode(packed)
                for column, (_, _, make) in zip(columns, makers, strict=True):
                    column.append(make(packed, decoded))
            arrays = [pa.array(column, kind) for column, (_, kind, _) in zip(columns, makers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["key", *outputs])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    out = out.mapInArrow(run, f"key {kind}, " + ", ".join(f"{name} {OUTPUTS[name][0]}" for name in outputs))
    return out.withColumnRenamed("key", key)


def vocabulary_path() -> str:
    """Where the installed vocabulary lies; it is read on the driver alone."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), vocabulary_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES, ORACLES = {"op9_bpe": op9_bpe}, {}

"""BPE against the tokenizers library, and exact round trips."""

import hashlib
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from depotlane.llm import bpe
from depotlane.llm.tables import slices

CASES = [
    "", " ", "  a", "a  b ", "\n\n x\t", "don't we'll I'm", "naïve café ßÄ", "日本語 テスト", "x" * 5000, "ab" * 3000,
    "<|endoftext|>", "a <|endoftext|>b", "1234 5.6", "  z", "\x1c\x1d a", "\u0085b", "é́", "🙂🙃 ok", " " * 300 + "q", "a\r\n b",
]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_path()))


def ids(encoder, text):
    packed = encoder(text)
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def test_equals_library(encoder):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(7)
    letters = "abc XYZ\n\t'.,0189éß日🙂 s t"
    texts = CASES + ["".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(400)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(encoder, text) == want, text
        assert encoder.decode(encoder(text)) == library.decode(want, skip_special_tokens=False) == text, text


def test_frame(spark):
    rows = [(1, "Hello  world", "x"), (2, None, "y"), (2, "", None), (None, "z" * 2000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.decoded) for r in bpe.encode(df, bpe.vocabulary_path()).collect()}
    assert (2, 0, "") in got and {g[2] for g in got} == {"Hello  world", "", "z" * 2000}
    assert bpe.encode(df.limit(0), bpe.vocabulary_path()).count() == 0
    names = ("decoded_sha256", "ids_sha256", "n_tokens")
    out = bpe.encode(df, bpe.vocabulary_path(), outputs=names)
    assert out.columns == ["doc_id", *names] and all(r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for r, t in zip(out.collect(), ["Hello  world", "", "", "z" * 2000], strict=True))


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "", "b" * 30, "c", "d" * 8])], ["key", "text"])
    parts = [p.column(0).to_pylist() for p in slices(batch, 1, 10)]
    assert sum(parts, []) == list(range(6)) and len(parts) > 1 and list(slices(batch.slice(0, 0), 1, 10)) == []

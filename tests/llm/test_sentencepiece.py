import random

import public_tokenizers
import pytest
import sentencepiece

from marlstone.llm import op1
from marlstone.llm.sentencepiece_bpe import PieceModel, decode, encode

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(FILE, "rb") as f:
        return PieceModel(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def texts():
    rng = random.Random(1)
    marks = " ▁  abcdefgh\n\t\x00éñ漢字😀́‍0123.,'\r<0x0A></s>"
    yield from ("", " ", "  a", "a  ", "▁", "hello world", "<s>x</s>", "a" * 3000, "ab" * 2000, " " * 777, "\u2047")
    for _ in range(3000):
        yield "".join(rng.choice(marks) for _ in range(rng.randint(0, 40)))
    for _ in range(1000):
        yield "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
    for _ in range(1000):
        yield "".join(chr(rng.choice([rng.randint(32, 0x2FFF), rng.randint(32, 255)])) for _ in range(30))


def test_encodes_as_the_library(model, library):
    for t in texts():
        assert model.encode(t).tolist() == library.encode(t), t[:80]


def test_decodes_as_the_library(model, library):
    rng = random.Random(2)
    for t in texts():
        ids = library.encode(t)
        assert model.decode(ids) == library.decode(ids)
    for _ in range(2000):
        ids = [rng.randint(0, 31999) if rng.random() < 0.6 else rng.randint(0, 300) for _ in range(12)]
        assert model.decode(ids) == library.decode(ids)


def test_frames(spark, library):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (None, None, 6), (3, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    out = decode(encode(docs, FILE), FILE)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted((r.doc_id or 0, list(r.ids), r.decoded) for r in out.collect())
    hello = library.encode("hello world")
    assert got == [(0, [], ""), (1, hello, "hello world"), (1, hello, "hello world"), (3, [], "")]
    assert encode(docs.limit(0), FILE).count() == 0


def test_query(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    got = {r.doc_id: r for r in op1.query(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()

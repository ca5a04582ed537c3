"""Byte-level BPE against the tokenizer library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from contrail.llm import bpe
from contrail.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_same_ids_as_the_library(vocab, library):
    draw = random.Random(5)
    letters = "aé'  \n\t srelvmtdT1½!日　\x00\x1c"
    texts = ["", " ", "'", "it's 'll they're've 's!'s '' ''s'x 'sabc", " 's", "ab  \n\n cd   ", "x" * 5000, " " * 700]
    texts += ["A!! BC!! !!!! ?!", "!" * 40]
    texts += ["日本語 テキスト１２３ ½", "\U0001e5d0\U0001e5f1 Ᲊ"]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(1500)]
    ids, offsets = vocab.encode([text.encode() for text in texts])
    for text, packed, places in zip(texts, ids, offsets):
        assert ids_of(packed) == library.encode_ordinary(text), repr(text)
        assert vocab.decode(packed, places) == text.encode()


def test_scan_equals_stepping(vocab):
    draw = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 4000):
        symbols = draw.integers(0, 9, n).astype(np.uint8)
        state, starts = bpe.CLOSED, []
        for at, symbol in enumerate(symbols):
            index = int(symbol) * bpe.STATES + state
            if bpe.STARTS[index]:
                starts.append(at)
            state = int(bpe.NEXT[index])
        assert bpe.piece_starts(symbols).tolist() == starts


def test_separators_do_not_leak(vocab, library):
    texts = ["a'", "s", "b ", " c", "", "'", "re"]
    ids, _ = vocab.encode([text.encode() for text in texts])
    assert [ids_of(packed) for packed in ids] == [library.encode_ordinary(text) for text in texts]


def test_documents(spark, library):
    ranks = bpe.load(spark, PATH)
    rows = [(1, None, "x"), (2, "", "y"), (3, "Same text's twin", "z"), (3, "Same text's twin", "z"), (None, "é" * 9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    found = bpe.encode_documents(docs, ranks).collect()
    assert len(found) == 5
    for row in found:
        text = row.text or ""
        assert ids_of(bytes(row.token_ids)) == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    assert bpe.encode_documents(docs.limit(0), ranks).count() == 0
    again = bpe.encode_documents(docs, ranks, decoded=False)
    assert "decoded" not in again.columns
    back = again.select("text", bpe.decode("token_ids", "token_offsets", ranks).alias("b")).collect()
    assert all(bytes(row.b) == (row.text or "").encode() for row in back)


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op1_byte_bpe"](spark, folder).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_clashing_names(spark, library):
    docs = spark.createDataFrame([(1, "one two", 7, 8, 9)], "doc_id long, text string, _coded long, `a.b` long, Decoded long")
    row = bpe.encode_documents(docs, bpe.load(spark, PATH)).first()
    assert (row["_coded"], row["a.b"], bytes(row["decoded"])) == (7, 8, b"one two")
    assert ids_of(bytes(row.token_ids)) == library.encode_ordinary("one two")

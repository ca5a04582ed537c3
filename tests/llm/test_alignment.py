import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contrail.llm import alignment, queries

A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


@pytest.fixture(scope="module")
def tools():
    return alignment.Tokenizers(open(A_FILE, "rb").read(), open(B_FILE, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def files(spark):
    return alignment.load(spark, A_FILE, B_FILE, P.PATTERN)


def brute(docs, libraries):
    """Whole texts by the two libraries, all links in one dictionary."""
    a_lib, b_lib = libraries
    letters = alignment._byte_letters()
    done = []
    for doc_id, text in docs:
        whole = (" " + (text or "")).encode()
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(b_lib.id_to_piece(i)[1:-1], 16)]) if b_lib.is_byte(i)
            else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b
        ]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            done.append((doc_id, [], [], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, links, at_a, at_b = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            i, j = a_ends.index(end, at_a), b_ends.index(end, at_b)
            groups.append(f"{','.join(map(str, a[at_a : i + 1]))}|{','.join(map(str, b[at_b : j + 1]))}")
            links.append((a[i], b[j]))
            at_a, at_b = i + 1, j + 1
        done.append((doc_id, a, b, groups, links))
    counts = Counter(link for d in done for link in d[4])
    most: Counter = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(
        (
            (
                doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links),
                sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
            )
            for doc_id, a, b, groups, links in done
        ),
        key=str,
    )


def ran(spark, docs, files, parts=3):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted(map(tuple, alignment.align(frame, files).collect()), key=str)


def odd_texts(seed, count):
    rng = random.Random(seed)
    bits = [
        " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "▁", "the", "It's", "don't", "1234", "x", "é", "日本語",
        "🙂", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "...", "ﬁ", "\x00", "\x1c", "\x85", "Straße", "слово", "á", "-",
        "​", "﻿", "word",
    ]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(count)]


def test_stretches_give_the_ids_of_whole_texts(tools, libraries):
    a_lib, b_lib = libraries
    good = 0
    for text in odd_texts(1, 3000):
        stretches = [s for part in alignment.slices(" " + text, 7) for s in alignment._STRETCH.findall(part)]
        assert "".join(stretches) == " " + text
        told = dict(tools.encode(stretches))
        found = [told[s] for s in stretches]
        assert a_lib.encode(" " + text, add_special_tokens=False).ids == [i for s in stretches for i in tools.a.encode_ordinary(s)]
        if all(found):
            good += 1
            assert b_lib.encode(text) == [i for _, b in found for i in b]
    assert good > 1000


def test_documents_equal_the_libraries(spark, files, libraries):
    docs = list(enumerate(odd_texts(2, 400))) + [(1000, None), (1001, ""), (1002, " "), (1003, "\n"), (1004, "the the the")]
    docs += [(1004, "the the the"), (None, "the"), (1005, "x" * 3000), (1006, "日本" * 500), (1007, "a ▁ b")]
    assert ran(spark, docs, files) == brute(docs, libraries)


def test_small_chunks_slices_and_caches(spark, files, libraries, monkeypatch, tools):
    """The parts of one process by hand, with every limit far below the data."""
    monkeypatch.setattr(alignment, "CHUNK_RECORDS", 60)
    monkeypatch.setattr(alignment, "SLICE", 9)
    monkeypatch.setattr(alignment, "CACHE_STRETCHES", 5)
    monkeypatch.setattr(alignment, "CACHE_PAIRS", 90)
    monkeypatch.setattr(alignment, "BLOCK", 7)
    monkeypatch.setattr(alignment.slices, "__defaults__", (9,))
    docs = list(enumerate(odd_texts(4, 200))) + [(900, "one two three " * 40 + "▁ four"), (901, "one two three " * 40)]
    import pyarrow as pa

    chunk, rows, number = alignment.Chunk(tools, 16, pa.int64()), [], 0
    for doc_id, text in docs:
        chunk.add(doc_id, text.encode())
        if chunk.full():
            rows += [(number, *part) for part in chunk.spilled()]
            number += 1
    rows += [(number, *part) for part in chunk.spilled()]
    assert number > 20
    runs = spark.createDataFrame([(c, p, bytearray(b)) for c, p, b in rows], alignment.RUN_SCHEMA)
    counted = alignment.written(alignment.count_pairs(runs), "c")
    back = alignment.counts_for_chunks(runs, counted)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    got = alignment._document_rows(runs.filter("part < 0").unionByName(back), schema)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, libraries)


def test_merged_runs_count_every_pair(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 5)
    rng = np.random.default_rng(1)
    wanted: Counter = Counter()
    merger = alignment.Merger(fan=3)
    for _ in range(40):
        keys = np.unique(rng.integers(0, 12, 30) << alignment.B_SHIFT | rng.integers(0, 9, 30))
        counts = rng.integers(1, 1 << 40, len(keys))
        wanted.update(dict(zip(keys.tolist(), counts.tolist())))
        merger.add(alignment.pack_run([(keys, counts)]))
        assert sum(map(len, merger.levels)) <= 3 * len(merger.levels)
    keys, counts, best = (np.concatenate(c).tolist() for c in zip(*alignment.run_blocks(merger.counted(), 3)))
    assert dict(zip(keys, counts)) == wanted and keys == sorted(keys)
    for key, count, top in zip(keys, counts, best):
        assert top == (count == max(n for k, n in wanted.items() if k >> 32 == key >> 32))


def test_empty_table_and_clashing_names(spark, files, libraries):
    assert ran(spark, [], files) == []
    docs = [(1, "one two"), (2, "two one")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("chunk", "part", "body", "n_a", "count_sum", "groups_sha256"):
        frame = frame.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, alignment.align(frame, files).collect())) == brute(docs, libraries)


def test_query_equals_the_libraries(spark, libraries):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_token_alignment"](spark, folder)
    assert got.columns == alignment.NAMES
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, libraries)

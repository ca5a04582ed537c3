"""Decontamination against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from contrail.llm import decontaminate
from contrail.llm.queries import QUERIES
from contrail.llm.text import words


def slow(items, text, window=13):
    parts = words((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        own = words((body or "").encode())
        size = min(window, len(own))
        for at in range(len(own) - size + 1 if own else 0):
            for place in range(len(parts) - size + 1):
                if parts[place : place + size] == own[at : at + size]:
                    hit |= set(range(place, place + size))
                    found.add(str(item))
    return len(parts), len(hit), sorted(found)


def test_automaton_against_brute_force():
    draw = random.Random(2)
    for trial in range(150):
        letters = "abcd"[: draw.randint(1, 4)]
        sequence = lambda n: " ".join(draw.choice(letters) for _ in range(n))
        items = [(f"i{k}", sequence(draw.randint(0, 9))) for k in range(draw.randint(0, 5))]
        window = draw.randint(1, 5)
        automaton = decontaminate.Automaton([(i, words(t.encode())) for i, t in items], window)
        for _ in range(6):
            text = sequence(draw.randint(0, 25))
            spans, found = automaton.scan(words(text.encode()))
            n_words, n_hit, ids = slow(items, text, window)
            assert sum(b - a for a, b in spans) == n_hit, (items, text, window)
            assert sorted(found) == ids
            assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("block_bytes", [1 << 30, 60])
def test_documents(spark, block_bytes):
    draw = random.Random(4)
    passage = lambda n: " ".join(f"w{draw.randint(0, 30)}" for _ in range(n))
    items = [(k, passage(draw.choice([3, 14, 20]))) for k in range(12)] + [(40, ""), (41, None), (3, "Alpha é beta"), (None, "lone words")]
    texts = [passage(30) + " " + items[k][1].upper() + ". " + passage(40) for k in range(12)]
    texts += ["alpha É beta", "ALPHA é beta lone words", None, "", passage(3000)]
    texts.append(texts[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hits", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.with_hits(docs, bench, block_bytes=block_bytes).collect()
    assert len(found) == len(texts)
    for row in found:
        n_words, n_hit, ids = slow(items, row.text)
        assert (row.hits.n_words, row.hits.n_hit) == (n_words, n_hit)
        assert sorted(row.hits["items"]) == [i for i in ids if i != "None"]
        assert row.hits.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)
    assert decontaminate.with_hits(docs, bench.limit(0)).agg(F.sum("hits.n_hit")).first()[0] == 0
    assert decontaminate.with_hits(docs.limit(0), bench).count() == 0


def test_spans_are_cut(spark):
    item = " ".join(f"q{k}" for k in range(14))
    docs = spark.createDataFrame([(1, f"Before, {item}! After"), (2, None), (3, "clean")], "doc_id long, text string")
    hits = decontaminate.with_hits(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    cut = hits.select("doc_id", decontaminate.cut_spans("text", "hits.starts", "hits.ends").alias("t")).collect()
    assert {r.doc_id: r.t for r in cut} == {1: "Before, ! After", 2: None, 3: "clean"}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    grams = {}
    for item, text in bench:
        own = words(text.encode())
        size = min(13, len(own))
        for at in range(len(own) - size + 1):
            grams.setdefault(tuple(own[at : at + size]), set()).add(str(item))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op7_decontamination"](spark, folder).collect()
    assert len(found) == len(texts) and any(r.contaminated for r in found)
    for row in found:
        parts, hit, ids = words(texts[row.doc_id].encode()), set(), set()
        for at in range(len(parts) - 12):
            if tuple(parts[at : at + 13]) in grams:
                hit |= set(range(at, at + 13))
                ids |= grams[tuple(parts[at : at + 13])]
        assert (row.n_words, row.n_hit, row.n_items) == (len(parts), len(hit), len(ids))
        assert row.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()

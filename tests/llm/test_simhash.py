"""SimHash classes against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contrail.llm import simhash
from contrail.llm.links import connected
from contrail.llm.queries import QUERIES


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_classes(prints):
    """fp -> smallest fp reachable."""
    codes = sorted(set(prints))
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {c: find(c) for c in codes}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A  b\tc\nd e é f " * 9, "w " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("bucket", [1024, 3])
def test_links_lose_nothing(spark, bucket):
    draw = random.Random(3)
    codes = set()
    for _ in range(25):
        centre = draw.getrandbits(64)
        for _ in range(16):
            code = centre
            for bit in draw.sample(range(64), draw.randint(0, 7)):
                code ^= 1 << bit
            codes.add(code - (1 << 64) if code >> 63 else code)
    wanted = slow_classes(codes)
    distinct = spark.createDataFrame([(c,) for c in codes], "fp long")
    links = simhash.fingerprint_links(distinct, bucket)
    found = {r.node: r.root for r in connected(links).collect()}
    assert {c: found.get(c, c) for c in codes} == wanted


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (7, 7), (3, 4), (4, 3)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 400: 400, 500: 400}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " tail"), (9, base), (9, base), (1, None), (2, ""), (7, "other words here now"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    found = sorted((r.doc_id or 0, r.component_id) for r in simhash.simhash_classes(docs).collect())
    assert found == [(0, 3), (1, 1), (2, 1), (3, 3), (5, 3), (7, 7), (9, 3), (9, 3)]
    assert simhash.simhash_classes(docs.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    prints = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    roots, least = slow_classes(prints.values()), {}
    for doc, code in prints.items():
        least[roots[code]] = min(doc, least.get(roots[code], doc))
    for row in QUERIES["op4_simhash"](spark, folder).collect():
        assert row.fingerprint == f"{prints[row.doc_id]:016x}"
        assert row.component_id == least[roots[prints[row.doc_id]]]
    assert np.bitwise_count(np.uint64(3)) == 2

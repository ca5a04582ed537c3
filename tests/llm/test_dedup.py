"""Repeated byte strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.llm import dedup
from contrail.llm.queries import QUERIES
from contrail.llm.suffixes import lyndon_groups, suffix_array


def slow(rows, length):
    """Removed runs of each (id, text)."""
    first = {}
    for one, text in sorted(rows, key=lambda r: r[0]):
        body = text.encode()
        for at in range(len(body) - length + 1):
            gram = body[at : at + length]
            first[gram] = min(first.get(gram, (one, at)), (one, at))
    out = {}
    for one, text in rows:
        body, gone = text.encode(), set()
        for at in range(len(body) - length + 1):
            if first[body[at : at + length]] < (one, at):
                gone |= set(range(at, at + length))
        starts = [a for a in sorted(gone) if a - 1 not in gone]
        ends = [a + 1 for a in sorted(gone) if a + 1 not in gone]
        out[one, text] = starts, ends
    return out


def test_suffix_array():
    draw = random.Random(1)
    for _ in range(1500):
        text = bytes(draw.choice(b"abc"[: draw.randint(1, 3)]) for _ in range(draw.randint(0, 16)))
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    text = b"mississippi" * 40
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_groups_are_lyndon_prefixes():
    draw = random.Random(2)
    for _ in range(300):
        text = bytes(draw.choice(b"ab") for _ in range(draw.randint(1, 12)))
        groups, sizes = lyndon_groups(text)
        words = [text[own[0] : own[0] + size] for own, size in zip(groups, sizes)]
        assert words == sorted(set(words))
        for own, size in zip(groups, sizes):
            for at in own:
                lyndon = [k for k in range(1, len(text) - at + 1) if all(text[at : at + k] < text[at + j : at + k] for j in range(1, k))]
                assert size == max(lyndon)


def test_equal_windows_choose_equal_anchors():
    draw = np.random.default_rng(3)
    for _ in range(50):
        text = draw.integers(97, 99, 200).astype(np.uint8)
        chosen = {}
        for key, first, wins, at in zip(*dedup.anchors(text, 12, 5)):
            for window in range(first, first + wins):
                gram = text[window : window + 12].tobytes()
                assert chosen.setdefault(gram, (key, first + at - window)) == (key, first + at - window)


@pytest.mark.parametrize("limits", [{}, {"key_contexts": 1}, {"sample": 1, "common": 2}, {"part_bytes": 300}])
def test_against_brute_force(spark, limits):
    draw = random.Random(6)
    letters = ["ab", "ba", "c", "é", "xyz", "q"]
    passage = "".join(draw.choice(letters) for _ in range(30))
    rows = []
    for one in range(60):
        text = "".join(draw.choice(letters[: 2 + one % 5]) for _ in range(draw.randint(0, 60)))
        if one % 3 == 0:
            text += passage + "".join(draw.choice(letters) for _ in range(6))
        rows.append((draw.randint(0, 10_000) * 2 + 1, text))
    rows += [(rows[5][0], rows[5][1]), (1 << 40, rows[5][1]), (3 << 40, "a" * 300), (-7, "abab" * 30), (-7, "ab" * 20), (8, None), (10, ""), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    plain = [(dedup.LAST_ID if one is None else one, text or "") for one, text in rows]
    wanted = slow(plain, 12)
    found = dedup.remove_repeats(docs, length=12, gram=5, **limits).collect()
    assert len(found) == len(rows)
    seen = [(dedup.LAST_ID if r.doc_id is None else r.doc_id, r.n_bytes, tuple(r.starts), tuple(r.ends), bytes(r.kept)) for r in found]
    expected = []
    for one, text in plain:
        starts, ends = wanted[one, text]
        body = text.encode()
        kept = b"".join(body[a:b] for a, b in zip([0, *ends], [*starts, len(body)]))
        expected.append((one, len(body), tuple(starts), tuple(ends), kept))
    assert sorted(seen) == sorted(expected)


def test_empty(spark):
    assert dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    wanted = slow(rows, 100)
    texts = dict(rows)
    found = QUERIES["op6_suffix_dedup"](spark, folder).collect()
    assert len(found) == len(rows)
    for row in found:
        starts, ends = wanted[row.doc_id, texts[row.doc_id]]
        body = texts[row.doc_id].encode()
        kept = b"".join(body[a:b] for a, b in zip([0, *ends], [*starts, len(body)]))
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(body), len(body) - len(kept), len(starts))
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_buckets_grow_with_the_data(spark):
    docs = spark.createDataFrame([(k, "a text of fifty bytes, more or less of them here " * 4) for k in range(100)], "doc_id long, text string")

    def partitions(part_bytes):
        plan = dedup.remove_repeats(docs, part_bytes=part_bytes)._jdf.queryExecution().optimizedPlan().toString()
        return {int(n) for n in re.findall(r"RepartitionByExpression \[(?:id|bucket)[^\]]*\], (\d+)", plan)}

    assert partitions(1 << 24) == {4} and partitions(1000) == {20}

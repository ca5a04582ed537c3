"""Exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.llm import topk
from contrail.llm.queries import QUERIES


def slow(rows, queries, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = set()
    for i, q in good:
        if i in queries:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)
            found |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)}
    return found


@pytest.mark.parametrize("scale, width", [(0.2, 17), (1.0, 3), (0.01, 8), (1e6, 5)])
def test_search_keeps_the_best(scale, width):
    draw = np.random.default_rng(width)
    vectors = draw.normal(0, scale, (700, width))
    vectors[300:320] = vectors[5]  # ties
    rows = list(enumerate(vectors.tolist()))
    search = topk.Search(np.arange(0, 700, 50), topk.to_integers([np.array(v) for _, v in rows[::50]]), 5)
    for at in range(0, 700, 90):
        part = rows[at : at + 90]
        search.look_at(np.array([i for i, _ in part]), topk.to_integers([np.array(v) for _, v in part]))
    found = {(int(search.ids[o]), int(j), int(s)) for o, j, s in zip(search.owner, search.found, search.scores)}
    assert found == {(i, j, s) for i, _, j, s in slow(rows, set(range(0, 700, 50)), 5)}


@pytest.mark.parametrize("block", [4096, 2])
def test_odd_rows(spark, block):
    rows = [(0, [0.5, -0.25]), (50, [0.1, 0.2]), (100, None), (150, [float("nan"), 1.0]), (200, [1.0, None]), (1, [0.5, -0.25]),
            (2, []), (3, [0.3]), (4, [float("inf"), 0.0]), (5, [1e6, -1e6]), (250, [2e7, 2e7, 1.0]), (7, [0.1, 0.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    asked = frame.filter("vec_id % 50 = 0")
    found = {tuple(r) for r in topk.top_k(frame, asked, query_block=block).collect()}
    assert found == slow(rows, set(range(0, 1000, 50)), 5)
    assert topk.top_k(frame, asked.limit(0)).count() == 0
    assert topk.top_k(frame.limit(0), asked.limit(0)).count() == 0
    twice = topk.top_k(frame.unionAll(frame), asked.unionAll(asked)).filter("query_id = 0").orderBy("rank").collect()
    assert [r.rank for r in twice] == [1, 2, 3, 4, 5] and twice[0].vec_id == twice[1].vec_id


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = {tuple(r) for r in QUERIES["op5_topk"](spark, folder).collect()}
    assert found == slow(rows, {i for i, _ in rows if i % 50 == 0}, 5)

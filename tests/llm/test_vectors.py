import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.llm import queries, vectors

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of every row by comparing all pairs."""
    fit = [
        r for r in rows
        if r[0] is not None and r[2] is not None and r[1]
        and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    ]
    units = [np.array(r[1], float) / np.abs(np.array(r[1], float)).max() for r in fit]
    units = [u / np.linalg.norm(u) for u in units]
    near = [
        [j for j, b in enumerate(fit) if i != j and a[2] == b[2] and len(a[1]) == len(b[1]) and units[i] @ units[j] >= threshold]
        for i, a in enumerate(fit)
    ]
    out, seen = [], {}
    for i in range(len(fit)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            new = set(near[todo.pop()]) - group
            group |= new
            todo += new
        seen.update(dict.fromkeys(group, min(fit[j][0] for j in group)))
    out = [(fit[i][0], len(near[i]), seen[i], fit[i][0] == seen[i]) for i in range(len(fit))]
    return sorted(out + [(r[0], 0, r[0], r[0] is not None) for r in rows if r not in fit], key=str)


def ran(frame, **options):
    return sorted(map(tuple, vectors.near_copies(frame, **options).collect()), key=str)


def clouds(n, seed=1, noise=0.04, labels=3, width=24):
    """Groups of near copies of growing size, with single vectors between them."""
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    while len(rows) < n:
        centre = rng.standard_normal(width)
        for _ in range(int(rng.choice([1, 1, 1, 2, 3, 9]))):
            x = centre + noise * rng.standard_normal(width) * rng.choice([0, 1, 3])
            rows.append((at, [float(np.float32(v)) for v in x], int(rng.integers(labels))))
            at += 1
    return rows[:n]


@pytest.mark.parametrize("tile", [2, 5, 1024])
def test_links_and_components_equal_all_pairs(spark, tile):
    rows = clouds(400)
    frame = spark.createDataFrame(rows, KIND).repartition(5)
    got, wanted = ran(frame, tile=tile, recall=0.999999), brute(rows)
    assert got == wanted and sum(w[1] for w in wanted) > 100


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest there are."""
    rng = np.random.default_rng(5)
    rows = []
    for at in range(0, 800, 2):
        a, b = rng.standard_normal((2, 32))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(at, a.tolist(), 1), (at + 1, (0.9302 * a + math.sqrt(1 - 0.9302**2) * b).tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    linked = sum(1 for r in ran(frame) if r[1])
    wanted = sum(1 for r in brute(rows) if r[1])
    assert wanted == 800 and linked >= 0.98 * wanted


def test_one_group_of_copies_and_one_of_near_copies(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    near = [(i, (centre + 0.01 * rng.standard_normal(16)).tolist(), 7) for i in range(300)]
    rows = near + [(1000 + i, [1.0] * 16, 7) for i in range(300)] + [(2000, [1.0] * 16, 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert ran(frame, tile=32) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [], 1),
        (6, [None, 1.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1),
        (10, [1.0, 0.0, 0.0], 1), (11, [1e30, 1e28], 1), (12, [-1.0, 0.0], 1), (-3, [1e-30, 1e-32], 1), (2, [0.0, 1.0], 1),
        (13, [-0.0, 5.0], 1),
    ]
    got = ran(spark.createDataFrame(rows, KIND))
    by_id = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert by_id[1] == (1, 4, -3, False) and by_id[11] == (11, 4, -3, False) and by_id[-3] == (-3, 4, -3, True)
    assert sorted(r for r in got if r[0] == 2) == [(2, 1, 2, True), (2, 4, -3, False), (2, 4, -3, False)]
    assert by_id[13] == (13, 1, 2, False)
    for alone in (3, 4, 5, 6, 7, 8, 9, 10, 12):
        assert by_id[alone] == (alone, 0, alone, True)
    assert by_id[None] == (None, 0, None, False)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], KIND)
    assert ran(empty) == []
    rows = clouds(60)
    frame = spark.createDataFrame(rows, KIND)
    plain = ran(frame)
    for name in ("node", "codes", "label_", "root", "n_links", "component_id", "vector"):
        frame = frame.withColumn(name, F.lit("x"))
    assert ran(frame) == plain


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, queries.QUERIES["op11_embedding_dedup"](spark, folder).collect()), key=str)
    assert got == brute(rows)


def test_layout_keeps_its_promise():
    for rows in (1, 100, 10_000, 10**6, 10**9):
        bits, tables = vectors.layout(rows)
        same = (1 - math.acos(0.93) / math.pi) ** bits
        assert 1 - (1 - same) ** tables >= 0.995 and rows / 2**bits <= max(16, rows / 2**30)

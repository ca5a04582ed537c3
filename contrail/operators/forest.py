"""Isolation forest scores (Liu, Ting and Zhou, 2008) over all rows.

Trees are grown from small hash-drawn samples, one group per tree; the finished
forest has a fixed maximum size and goes to every task, which scores its own rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from contrail.session import written

NODE_SCHEMA = "tree int, drawn int, node int, feature int, split double, low int, high int, depth double"


def mean_path(n: float) -> float:
    """Average depth of an unsuccessful search in a binary tree of n items."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def draw_samples(rows: DataFrame, id_col: str, features: list[str], trees: int, size: int, seed: int) -> DataFrame:
    """``size`` rows per tree, chosen by hash of the id, so any partitioning draws the same.

    A threshold on the hash first leaves about four times the needed rows; the
    lowest hashes of these make the sample.
    """
    total = rows.count()
    wanted = 4.0 * size * trees
    turns = max(1, min(trees, math.ceil(wanted / max(total, 1))))
    share = min(1.0, wanted / (max(total, 1) * turns))
    turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))) if turns > 1 else F.lit(0)
    span = 1 << 31
    drawn = (
        rows.select(id_col, *features)
        .withColumn("_turn", turn)
        .filter(F.pmod(F.xxhash64(id_col, "_turn", F.lit(seed)), F.lit(span)) < F.lit(int(share * span)))
        .withColumn("tree", F.pmod(F.xxhash64(id_col, "_turn", F.lit(seed + 1)), F.lit(trees)).cast("int"))
        .drop("_turn")
    )
    order = W.partitionBy("tree").orderBy("_h", id_col)
    return (
        drawn.dropDuplicates(["tree", id_col])
        .withColumn("_h", F.xxhash64(id_col, "tree", F.lit(seed + 2)))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= size)
        .drop("_h", "_n")
    )


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[tuple] = []
    todo = [(points, 0, 0)]
    nodes.append(())
    while todo:
        part, depth, at = todo.pop()
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (0, 0)
        varied = np.flatnonzero(high > low) if len(part) > 1 and depth < limit else np.array([], dtype=int)
        if not len(varied):
            nodes[at] = (at, -1, 0.0, -1, -1, depth + mean_path(len(part)))
            continue
        f = int(rng.choice(varied))
        split = float(rng.uniform(low[f], high[f]))
        left = part[:, f] < split
        a, b = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[at] = (at, f, split, a, b, 0.0)
        todo += [(part[left], depth + 1, a), (part[~left], depth + 1, b)]
    return nodes


def grow_forest(samples: DataFrame, id_col: str, features: list[str], size: int, seed: int) -> DataFrame:
    limit = max(1, math.ceil(math.log2(size)))

    def one_tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        rng = np.random.default_rng([seed, int(key[0])])
        nodes = _grow(pdf[features].to_numpy(dtype="float64"), rng, limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "split", "low", "high", "depth"])
        out.insert(0, "drawn", len(pdf))
        out.insert(0, "tree", int(key[0]))
        return out

    return samples.groupBy("tree").applyInPandas(one_tree, NODE_SCHEMA)


def isolation_scores(
    rows: DataFrame,
    id_col: str,
    features: list[str],
    trees: int = 100,
    size: int = 256,
    seed: int = 7,
) -> DataFrame:
    """(id, score) for every row; a missing feature counts as 0, scores lie in (0, 1)."""
    full = rows.select(id_col, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    # counted, drawn from and scored: three passes over one computation
    full = written(full, "forest")
    samples = draw_samples(full, id_col, features, trees, size, seed)
    # at most trees * (2 * size) nodes, whatever the data size
    nodes = grow_forest(samples, id_col, features, size, seed).toPandas().sort_values(["tree", "node"])
    forest = [
        (g["feature"].to_numpy(), g["split"].to_numpy(), g["low"].to_numpy(), g["high"].to_numpy(), g["depth"].to_numpy())
        for _, g in nodes.groupby("tree")
    ]
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    # the path length is measured against the samples the trees were really grown from
    drawn = nodes.groupby("tree")["drawn"].first().mean() if len(nodes) else 2
    norm = mean_path(max(2.0, drawn))
    steps = max(1, math.ceil(math.log2(size)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].to_numpy(dtype="float64")
            here = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, split, low, high, depth in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(steps):
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes_low = x[here, np.maximum(f, 0)] < split[at]
                    at = np.where(inner, np.where(goes_low, low[at], high[at]), at)
                total += depth[at]
            yield pd.DataFrame(
                {id_col: batch[id_col], "score": np.exp2(-(total / max(len(shared.value), 1)) / norm)}
            )

    id_type = full.schema[id_col].dataType.simpleString()
    return full.mapInPandas(score, f"{id_col} {id_type}, score double")

"""Shapley values of tree ensembles, exact, per row.

What a tree expects when only some features are known follows the row where a split's
feature is known and otherwise both branches, weighted by how many background rows took each. A leaf's
share of that is a product over the features on its path: one if the row keeps to the leaf's
side, or the share of background rows that do. So a leaf is a small game of its own, and
its Shapley values come from the coefficients of a polynomial with a factor per feature, in time
that grows with the square of the path and not with the subsets. Values over all leaves, trees and
weights add up; with the mean over the background they give the prediction.

The ensemble is as large as its parameters say and goes to every task; rows are scored where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, functions as F

BATCH = 4096
TABLE_FEATURES = 10  # leaves with so many features on their path keep the values of all patterns


@dataclass
class Tree:
    """Nodes as columns; ``feature`` is -1 for leaves, a row goes left if its value is at most ``split``."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: float = 1.0
    cover: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Leaf:
    """A weighted leaf with, per feature on its path, the open-closed range and the share of rows that take it.

    ``table`` holds the values of every pattern of kept features, once they were asked for.
    """

    value: float
    features: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    table: np.ndarray | None = None


def trees_of(model: GBTRegressionModel) -> list[Tree]:
    """The trees of a fitted ensemble; all splits are on numbers."""
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights):
        columns: list[list] = [[], [], [], [], []]
        todo = [(tree._call_java("rootNode"), None, 0)]
        while todo:
            node, parent, side = todo.pop()
            at = len(columns[0])
            if parent is not None:
                columns[side][parent] = at
            inner = node.getClass().getSimpleName() == "InternalNode"
            split = node.split() if inner else None
            row = (split.featureIndex(), split.threshold(), -1, -1) if inner else (-1, 0.0, -1, -1)
            for column, value in zip(columns, (*row, node.prediction())):
                column.append(value)
            if inner:
                todo += [(node.leftChild(), at, 2), (node.rightChild(), at, 3)]
        kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
        trees.append(Tree(*[np.array(c, k) for c, k in zip(columns, kinds)], weight=weight))
    return trees


def reached(tree: Tree, x: np.ndarray) -> Iterator[np.ndarray]:
    """The nodes that rows stand on, level by level; rows stay on their leaf."""
    at = np.zeros(len(x), np.int64)
    here = np.arange(len(x))
    yield at
    while True:
        f = tree.feature[at]
        inner = f >= 0
        if not inner.any():
            return
        goes_left = x[here, np.maximum(f, 0)] <= tree.split[at]
        at = np.where(inner, np.where(goes_left, tree.left[at], tree.right[at]), -1)
        kept = at >= 0
        x, at = x[kept], at[kept]
        here = np.arange(len(x))
        yield at


def covers(trees: list[Tree], rows: DataFrame, inputs: list[str]) -> list[Tree]:
    """The trees with the number of background rows that reach each node, counted in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(len(tree.feature), np.int64) for tree in shared.value]
        for batch in batches:
            x = batch[inputs].to_numpy("float64")
            for seen, tree in zip(held, shared.value):
                for at in reached(tree, x):
                    seen += np.bincount(at, minlength=len(seen))
        for number, seen in enumerate(held):
            yield pd.DataFrame({"tree": number, "node": np.arange(len(seen)), "n": seen})

    counted = rows.select(*inputs).mapInPandas(count, "tree int, node int, n bigint").groupBy("tree", "node")
    # at most as many rows as the ensemble has nodes
    found = counted.agg(F.sum("n").alias("n")).toPandas()
    out = []
    for number, tree in enumerate(trees):
        cover = np.zeros(len(tree.feature))
        own = found[found["tree"] == number]
        cover[own["node"].to_numpy()] = own["n"].to_numpy()
        out.append(Tree(tree.feature, tree.split, tree.left, tree.right, tree.value, tree.weight, cover))
    return out


def leaves(tree: Tree) -> list[Leaf]:
    """The leaves with what their paths ask of each feature."""
    found = []
    todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while todo:
        node, path = todo.pop()
        f = int(tree.feature[node])
        if f < 0:
            asked = np.array([path[g] for g in path]).reshape(-1, 3)
            found.append(Leaf(float(tree.value[node] * tree.weight), list(path), *asked.T))
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        split, cover = float(tree.split[node]), float(tree.cover[node])
        for child, bounds in ((tree.left[node], (low, min(high, split))), (tree.right[node], (max(low, split), high))):
            part = float(tree.cover[child]) / cover if cover else 0.0
            todo.append((int(child), {**path, f: (*bounds, share * part)}))
    return found


def leaf_values(kept: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the games prod(kept or share), one game per row of ``kept``, one column per feature.

    The product over the other features of (share + kept t) holds at t^s the sum over all their
    subsets of s known ones.
    """
    games, size = kept.shape
    values = np.zeros((games, size))
    weights = np.array([1 / (size * comb(size - 1, s)) for s in range(size)])
    for f in range(size):
        known = np.zeros((games, size))
        known[:, 0] = 1.0
        for g in range(size):
            if g != f:
                more = known * share[g]
                more[:, 1:] += known[:, :-1] * kept[:, g : g + 1]
                known = more
        values[:, f] = (kept[:, f] - share[f]) * (known @ weights)
    return values


def pattern_values(leaf: Leaf, codes: np.ndarray) -> np.ndarray:
    """The leaf's values for patterns of kept features given as numbers, the first feature as the lowest bit."""
    patterns = codes[:, None] >> np.arange(len(leaf.features)) & 1
    return leaf.value * leaf_values(patterns.astype(float), leaf.share)


def row_values(games: list[Leaf], x: np.ndarray) -> np.ndarray:
    """One Shapley value per row and feature."""
    out = np.zeros(x.shape)
    for leaf in games:
        if not leaf.features or not leaf.value:
            continue
        side = x[:, leaf.features]
        kept = (side > leaf.low) & (side <= leaf.high)
        code = kept @ (1 << np.arange(len(leaf.features)))
        if len(leaf.features) <= TABLE_FEATURES:
            if leaf.table is None:
                leaf.table = pattern_values(leaf, np.arange(1 << len(leaf.features)))
            out[:, leaf.features] += leaf.table[code]
        else:
            # few patterns of kept features occur
            codes, which = np.unique(code, return_inverse=True)
            out[:, leaf.features] += pattern_values(leaf, codes)[which.ravel()]
    return out


def mean_value(games: list[Leaf]) -> float:
    """The prediction with no feature known: the mean over the background rows."""
    return sum(leaf.value * float(np.prod(leaf.share)) for leaf in games)


def shapley_values(trees: list[Tree], rows: DataFrame, inputs: list[str], keep: list[str]) -> DataFrame:
    """``keep``, base, and a column per input with its value; base and values of a row add up to its prediction.

    ``trees`` carry their covers. Missing inputs must have been filled.
    """
    games = [leaf for tree in trees for leaf in leaves(tree)]
    base = mean_value(games)
    shared = rows.sparkSession.sparkContext.broadcast(games)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                values = row_values(shared.value, part[inputs].to_numpy("float64"))
                out = part[keep].reset_index(drop=True)
                out["base"] = base
                yield pd.concat([out, pd.DataFrame(values, columns=[f"phi_{name}" for name in inputs])], axis=1)

    kinds = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in keep)
    schema = f"{kinds}, base double, " + ", ".join(f"phi_{name} double" for name in inputs)
    return rows.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(score, schema)


def by_feature(values: DataFrame, inputs: list[str]) -> DataFrame:
    """Mean size and mean of each input's values."""
    cells = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"phi_{name}").alias("phi")) for name in inputs])
    return (
        values.select(F.explode(cells).alias("c"))
        .groupBy("c.feature")
        .agg(
            F.round(F.avg(F.abs("c.phi")), 6).alias("mean_abs"),
            F.round(F.avg("c.phi"), 6).alias("mean"),
            F.count(F.lit(1)).alias("rows"),
        )
    )

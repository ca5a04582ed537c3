from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import functions as F

from contrail.operators import models, shapley
from test_models import flights_with_signal


def grown(rng, features, depth, background):
    """A random tree with covers from the background rows."""
    feature, split, left, right, value = [], [], [], [], []

    def node(level):
        at = len(feature)
        inner = level < depth and rng.random() < 0.85
        feature.append(int(rng.integers(features)) if inner else -1)
        split.append(float(np.round(rng.standard_normal(), 2)))
        left.append(-1)
        right.append(-1)
        value.append(float(rng.standard_normal()))
        if inner:
            left[at], right[at] = node(level + 1), node(level + 1)
        return at

    node(0)
    tree = shapley.Tree(*map(np.array, (feature, split, left, right, value)), weight=float(rng.random() + 0.5))
    cover = np.zeros(len(feature))
    for at in shapley.reached(tree, background):
        cover += np.bincount(at, minlength=len(feature))
    tree.cover = cover
    return tree


def expected(tree, x, known, at=0):
    f = tree.feature[at]
    if f < 0:
        return tree.value[at] * tree.weight
    sides = tree.left[at], tree.right[at]
    if f in known:
        return expected(tree, x, known, sides[0] if x[f] <= tree.split[at] else sides[1])
    if not tree.cover[at]:
        return 0.0
    return sum(tree.cover[s] / tree.cover[at] * expected(tree, x, known, s) for s in sides)


def brute(trees, x):
    """Over all subsets of the features."""
    size = len(x)
    worth = {s: sum(expected(t, x, s) for t in trees) for r in range(size + 1) for s in combinations(range(size), r)}
    out = np.zeros(size)
    for f in range(size):
        for s in worth:
            if f not in s:
                out[f] += (worth[tuple(sorted((*s, f)))] - worth[s]) / (size * comb(size - 1, len(s)))
    return out


def test_values_equal_all_subsets():
    rng = np.random.default_rng(2)
    for features in (1, 3, 6):
        background = rng.standard_normal((400, features))
        trees = [grown(rng, features, 6, background) for _ in range(4)]
        games = [leaf for tree in trees for leaf in shapley.leaves(tree)]
        x = np.vstack([rng.standard_normal((25, features)), background[:5]])
        found = shapley.row_values(games, x)
        assert np.allclose(found, [brute(trees, row) for row in x], atol=1e-10)
        full = [sum(expected(t, row, range(features)) for t in trees) for row in x]
        assert np.allclose(found.sum(1) + shapley.mean_value(games), full, atol=1e-10)


def test_rows_on_a_split_and_branches_nobody_took():
    tree = shapley.Tree(*map(np.array, ([0, -1, 1, -1, -1], [1.0, 0, 5.0, 0, 0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0, 1.0, 0, 2.0, 3.0])))
    tree.cover = np.array([4.0, 4, 0, 0, 0])
    games = shapley.leaves(tree)
    x = np.array([[1.0, 9.0], [1.1, 5.0], [1.1, 5.1]])
    found = shapley.row_values(games, x)
    assert shapley.mean_value(games) == 1.0 and np.allclose(found.sum(1) + 1.0, [1.0, 2.0, 3.0])


def test_a_long_path_takes_polynomial_time():
    depth = 40
    feature = [f for d in range(depth) for f in (d, -1)] + [-1]
    left = [n for d in range(depth) for n in (2 * d + 1, -1)] + [-1]
    right = [n for d in range(depth) for n in (2 * d + 2, -1)] + [-1]
    tree = shapley.Tree(*map(np.array, (feature, [0.0] * len(feature), left, right, list(np.linspace(-1, 1, len(feature))))))
    x = np.random.default_rng(1).standard_normal((50, depth)) + 0.5
    cover = np.zeros(len(feature))
    for at in shapley.reached(tree, x):
        cover += np.bincount(at, minlength=len(feature))
    tree.cover = cover
    games = shapley.leaves(tree)
    full = [expected(tree, row, range(depth)) for row in x]
    assert np.allclose(shapley.row_values(games, x).sum(1) + shapley.mean_value(games), full)


def test_values_of_the_fitted_model_add_up(spark):
    train, test = models.split_by_time(models.model_rows(flights_with_signal(spark)))
    model = models.fit(train, iterations=4)
    values = models.shapley_rows(model, test, train).toPandas()
    phi = values[[f"phi_{name}" for name in models.INPUTS]]
    assert len(values) == test.count() and np.allclose(phi.sum(axis=1) + values["base"], values["prediction"])
    mean = models.score(model, train).agg(F.avg("prediction")).first()[0]
    assert np.allclose(values["base"], mean)
    told = shapley.by_feature(models.shapley_rows(model, test, train), models.INPUTS).toPandas().set_index("feature")
    assert told["mean_abs"].idxmax() == "recent_mean_delay" and told.loc["visibility_miles", "mean_abs"] == 0
    assert (told["rows"] == len(values)).all()


def test_values_of_a_leaf_are_worked_out_once(monkeypatch):
    """However many rows come, a leaf's patterns are valued once; leaves with long paths give the same."""
    rng = np.random.default_rng(6)
    games = [
        shapley.Leaf(2.0, [3, 0], np.array([-0.5, -np.inf]), np.array([np.inf, 0.3]), np.array([0.4, 0.6])),
        shapley.Leaf(-1.5, [1, 2, 4], np.array([-1.0, 0.0, -0.2]), np.array([0.5, np.inf, 0.9]), np.array([0.2, 0.5, 0.7])),
    ]
    calls = []
    plain = shapley.leaf_values
    monkeypatch.setattr(shapley, "leaf_values", lambda kept, share: calls.append(len(kept)) or plain(kept, share))
    batches = [rng.standard_normal((500, 5)) for _ in range(4)]
    got = [shapley.row_values(games, x) for x in batches]
    assert calls == [4, 8]
    for x, values in zip(batches, got):
        wanted = np.zeros(x.shape)
        for leaf in games:
            kept = (x[:, leaf.features] > leaf.low) & (x[:, leaf.features] <= leaf.high)
            wanted[:, leaf.features] += leaf.value * plain(kept.astype(float), leaf.share)
        assert np.allclose(values, wanted, atol=1e-12)
    monkeypatch.setattr(shapley, "TABLE_FEATURES", 1)
    assert np.allclose(shapley.row_values(games, batches[0]), got[0], atol=1e-12) and len(calls) == 4

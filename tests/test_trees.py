"""Deep regression trees: against MLlib's trees and a loop over the rows."""

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

from retentio.operators import selection as sel
from retentio.operators import trees

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 4)).round(2)
    x[:, 2] = rng.integers(0, 3, 1200)
    x[:, 3] = 7.0
    y = (40 * x[:, 0] - 25 * x[:, 1] * x[:, 2] + rng.normal(size=1200) * 20).round()
    x[:300], y[:300] = 0.0, 5.0  # a heap of equal rows
    data = [tuple(float(v) for v in r) + (float(t),) for r, t in zip(x, y)]
    return spark.createDataFrame(data, "a double, b double, c double, d double, y double")


def importances(imp):
    return {r["feature"]: r["importance"] for r in imp.collect()}


@pytest.mark.parametrize("node_rows, most", [(4096, 65536), (40, 60)])
@pytest.mark.parametrize("depth", [2, 30])
def test_tree_equals_mllib_and_mllib_grows_only_the_top(spark, rows, monkeypatch, depth, node_rows, most):
    asked = []

    def grown(**kw):
        asked.append(kw["maxDepth"])
        return DecisionTreeRegressor(**kw)

    monkeypatch.setattr(trees, "NODE_ROWS", node_rows)
    monkeypatch.setattr(trees, "MOST_NODE_ROWS", most)
    monkeypatch.setattr(trees, "DecisionTreeRegressor", grown)
    got = importances(sel.tree_importance(rows, "y", "regression", max_depth=depth, features=FEATS))
    data = sel._assembled(rows, FEATS, "y")
    want = DecisionTreeRegressor(maxDepth=depth, maxBins=256, seed=42).fit(data).featureImportances.toArray()
    assert got == pytest.approx(dict(zip(FEATS, want)), abs=1e-9)
    assert max(asked) < 14


def test_forest_is_near_mllibs(spark, rows):
    got = importances(sel.forest_importance(rows, "y", "regression", n_trees=12, features=FEATS))
    data = sel._assembled(rows, FEATS, "y")
    want = RandomForestRegressor(numTrees=12, maxDepth=30, maxBins=256, featureSubsetStrategy="all",
                                 seed=1).fit(data).featureImportances.toArray()
    assert got == pytest.approx(dict(zip(FEATS, want)), abs=0.04)
    assert sum(got.values()) == pytest.approx(1)
    again = importances(sel.forest_importance(rows, "y", "regression", n_trees=12, features=FEATS))
    assert again == pytest.approx(got)


def test_forest_elimination_drops_the_constant_first(spark, rows):
    got = {r["feature"]: r["ranking"] for r in sel.rfe(rows.limit(600), 2, target="y", task="regression",
                                                       features=FEATS).collect()}
    assert got["d"] == 3 and sorted(got.values()) == [1, 1, 2, 3]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_rows(spark, rows, n):
    got = importances(sel.forest_importance(rows.orderBy("y").limit(n), "y", "regression", n_trees=8, features=FEATS))
    assert set(got) == set(FEATS)
    assert sum(got.values()) == pytest.approx(0) or sum(got.values()) == pytest.approx(1)


def loop_gains(bins, y, depth):
    """One node after the other, every cut tried in turn."""
    gains = np.zeros(bins.shape[1])
    if depth == 0 or len(y) < 2:
        return gains
    best = (0.0, None, None)
    for f in range(bins.shape[1]):
        for c in np.unique(bins[:, f])[:-1]:
            left = bins[:, f] <= c
            gain = y.var() - left.mean() * y[left].var() - (1 - left.mean()) * y[~left].var()
            if gain > best[0] + 1e-9:
                best = (gain, f, c)
    if best[1] is None:
        return gains
    left = bins[:, best[1]] <= best[2]
    gains[best[1]] += best[0] * len(y)
    return gains + loop_gains(bins[left], y[left], depth - 1) + loop_gains(bins[~left], y[~left], depth - 1)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("depth", [1, 3, 30])
def test_subtree_against_a_loop(seed, depth):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 80))
    bins, y = rng.integers(0, 9, (m, 3)), rng.integers(0, 50, m).astype(float)
    got = trees.subtree_gains(bins, np.ones(m), y, y * y, depth)
    np.testing.assert_allclose(got, loop_gains(bins, y, depth), atol=1e-6)


def test_cut_points():
    v = np.array([0.0, 1.0, 4.0])
    assert list(trees.cut_points(v, [1, 1, 1], 256)) == [0.5, 2.5]
    assert list(trees.cut_points(v[:1], [5], 256)) == []
    # one heavy value: the cuts fall at both sides of it
    assert list(trees.cut_points(np.arange(6.0), [1, 1, 50, 1, 1, 1], 3)) == [1.5, 2.5]


def test_small_forests_are_grown_whole_and_alike(spark, rows, monkeypatch):
    """One task a tree gives the trees that MLlib's upper levels and the
    subtrees below them give; MLlib is not asked."""
    table = trees.binned(sel._assembled(rows, FEATS, "y"), FEATS)
    with monkeypatch.context() as m:
        m.setattr(trees, "DecisionTreeRegressor", None)
        got = trees.regression_importances(table, FEATS, n_trees=5, seed=3)
        rounds = trees.forest_rounds(table, FEATS, n_trees=5, seed=3)
        again, fewer = rounds(FEATS), rounds(["c", "a"])
    monkeypatch.setattr(trees, "MOST_TREE_ROWS", 0)
    np.testing.assert_allclose(got, trees.regression_importances(table, FEATS, n_trees=5, seed=3), atol=1e-9)
    np.testing.assert_allclose(again, got, atol=1e-12)
    np.testing.assert_allclose(fewer, trees.regression_importances(table, ["c", "a"], n_trees=5, seed=3), atol=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_levels_by_counts_and_by_orders_are_alike(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    bins, y = rng.integers(0, 300 if seed else 12, (400, 3)), rng.integers(0, 50, 400).astype(float)
    n = rng.poisson(1, 400) + 1.0
    bins[:50], y[:50] = 3, 7.0
    got = {}
    for counted in (0, 8, 10**9):  # all by counts, both, all by orders
        monkeypatch.setattr(trees, "COUNTED_ROWS", counted)
        got[counted] = trees.subtree_gains(bins, n, n * y, n * y * y, 30)
        each = np.repeat(np.arange(400), n.astype(int))
        np.testing.assert_allclose(trees.subtree_gains(bins, n, n * y, n * y * y, 3),
                                   loop_gains(bins[each], y[each], 3), atol=1e-6)
    np.testing.assert_allclose(got[8], got[0], atol=1e-6)
    np.testing.assert_allclose(got[10**9], got[0], atol=1e-6)

"""Impurity importances of deep regression trees and forests.

MLlib keeps statistics of every feature and bin for each open node, however few
rows the node has, and a tree without a depth limit has about as many nodes as
rows. So MLlib grows the upper levels of a tree only; the rows of each node
reached there are grouped, and a task grows that node's subtree from its rows by
the same rule (largest fall of the variance; the first feature and the lowest
cut among equals). The trees of a forest, whose draws fit a task as packed bin
numbers, are grown whole, one tree a task; above that each tree is grown as
the single tree is.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.session import drop_written, write_once

# Rows a node should have when a task takes it over, the most it
# may have, the trees of a larger forest grown at a time, and the most rows of
# a draw that one task grows a whole tree from.
NODE_ROWS = 4_096
MOST_NODE_ROWS = 65_536
TREES_AT_A_TIME = 6
MOST_TREE_ROWS = 2_000_000
# Rows a node has at least, in the mean, for its level to be counted by bins.
COUNTED_ROWS = 512


def cut_points(values, counts, max_bins: int) -> np.ndarray:
    """Midpoints between the sorted distinct ``values``: all of them, or those
    where the rows passed come nearest to the next multiple of a bin's share."""
    mid = (values[:-1] + values[1:]) / 2
    if len(mid) < max_bins:
        return mid
    passed = np.cumsum(counts, dtype="float64")
    stride = passed[-1] / max_bins
    cuts, target = [], stride
    for i in range(1, len(values)):
        if abs(passed[i - 1] - target) < abs(passed[i] - target):
            cuts.append(mid[i - 1])
            target += stride
    return np.array(cuts)


def binned(data: DataFrame, features: list[str], max_bins: int = 256, seed: int = 42) -> DataFrame:
    """``data`` (``features`` vector, ``label``) as one column of bin numbers
    per feature and the label, all rows, written once. The cuts come from
    about max_bins² rows, as MLlib's do; any row's bin follows from its value."""
    n = max(data.count(), 1)
    share = max(max_bins ** 2, 10_000) / n
    known = data if share >= 1 else data.sample(False, share, seed)
    values = known.select(F.posexplode(vector_to_array("features")).alias("feature", "value")).groupBy(
        "feature", "value").agg(F.count(F.lit(1)).alias("n"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        found = cut_points(pdf["value"].to_numpy(), pdf["n"].to_numpy(), max_bins)
        return pd.DataFrame({"feature": pdf["feature"].iloc[:1], "cuts": [found]})

    rows = values.groupBy("feature").applyInPandas(cut, "feature int, cuts array<double>").collect()
    cuts = {r["feature"]: np.array(r["cuts"]) for r in rows}  # fewer than max_bins numbers per feature

    def put(frames):
        for pdf in frames:
            x = np.array(pdf["x"].to_list(), dtype="float64").reshape(len(pdf), len(features))
            out = {f: np.searchsorted(cuts[i], x[:, i]).astype("int16") for i, f in enumerate(features)}
            yield pd.DataFrame({**out, "label": pdf["label"]})

    schema = ", ".join(f"`{f}` smallint" for f in features) + ", label double"
    return write_once(data.select(vector_to_array("features").alias("x"), "label").mapInPandas(put, schema), "tree-bins")


def subtree_gains(bins: np.ndarray, n, s, q, depth: int) -> np.ndarray:
    """Fall of the squared error per feature in the tree of at most ``depth``
    levels grown from these rows: ``bins`` (rows × features) and, per row,
    the count, sum and sum of squares of its labels. All nodes of a level are
    split together: large ones by counts per bin, smaller ones along orders of
    their rows by bin, which a split only parts in two."""
    rows, p = bins.shape
    gains = np.zeros(p)
    if not rows:
        return gains
    width = int(bins.max(initial=0)) + 1
    cols = list(np.ascontiguousarray(bins.T.astype("uint8" if width <= 256 else "int32")))
    sums = [np.asarray(v, dtype="float64") for v in (n, s, q)]
    node, k, orders, sizes = np.zeros(rows, dtype="int64"), 1, None, None
    for _ in range(depth):
        if orders is None and len(node) < COUNTED_ROWS * k:
            cols, sums, orders, sizes = _ordered(cols, sums, node, k)
        if orders is None:
            total, best, feature, cut = _counted_splits(cols, sums, node, k, width)
        else:
            node = np.repeat(np.arange(k, dtype="int32"), sizes)
            total, best, feature, cut = _ordered_splits(cols, sums, orders, node, sizes)
        # labels that are all equal leave rounding behind
        split = (feature >= 0) & (_variance_of(*total) > 1e-13 * total[2] / total[0])
        if not split.any():
            break
        gains += np.bincount(feature[split], (best * total[0])[split], p)
        k = int(split.sum())
        if orders is None:
            kept = split[node]
            node, cols, sums = node[kept], [c[kept] for c in cols], [v[kept] for v in sums]
            above = _above(cols, feature, cut, node, np.arange(len(node)))
            node = (np.cumsum(split) - 1)[node] + above * k
        else:
            side = np.full(len(sums[0]), 2, dtype="int8")  # 0 left, 1 right, 2 in no split node
            above = _above(cols, feature, cut, node, orders[0])
            side[orders[0]] = np.where(split[node], above, 2)
            rights = np.add.reduceat(above.astype("int64"), np.cumsum(sizes) - sizes)[split]
            sizes = np.concatenate((sizes[split] - rights, rights))
            orders = [np.concatenate((o[side[o] == 0], o[side[o] == 1])) for o in orders]
        k *= 2
    return gains


def _above(cols, feature, cut, node, rows) -> np.ndarray:
    """Whether the row of each place lies above its node's cut."""
    out = np.zeros(len(node), dtype=bool)
    own = feature[node]
    for f, c in enumerate(cols):
        at = np.flatnonzero(own == f)
        out[at] = c[rows[at]] > cut[node[at]]
    return out


def _ordered(cols, sums, node, k: int):
    """The rows dealt by node, and per feature their order by (node, bin)."""
    place = np.argsort(node.astype("uint16") if k <= 65_536 else node, kind="stable")
    cols, sums, node = [c[place] for c in cols], [v[place] for v in sums], node[place]
    orders = []
    for c in cols:
        o = np.argsort(c, kind="stable")
        by_node = node[o]
        orders.append(o[np.argsort(by_node.astype("uint16") if k <= 65_536 else by_node, kind="stable")].astype("int32"))
    return cols, sums, orders, np.bincount(node, minlength=k)


def _gain(total, impurity, left):
    """Fall of the variance for the cuts that leave ``left`` of ``total``
    (each side has rows)."""
    share = left[0] / total[0]
    gain = impurity - share * _variance_of(*left)
    right = [t - x for t, x in zip(total, left)]
    gain -= right[0] / total[0] * _variance_of(*right)
    return gain


def _counted_splits(cols, sums, node, k: int, width: int):
    """Totals of the nodes, and their best fall, its feature (-1: none) and cut."""
    total = [np.bincount(node, v, k) for v in sums]
    impurity = _variance_of(*total)
    best, feature, cut = np.zeros(k), np.full(k, -1), np.zeros(k, dtype="int64")
    each = np.arange(k)
    for f, c in enumerate(cols):
        cell = node * width + c
        left = [np.bincount(cell, v, k * width).reshape(k, width).cumsum(axis=1) for v in sums]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = _gain([t[:, None] for t in total], impurity[:, None], left)
        gain[(left[0] <= 0) | (left[0] >= total[0][:, None])] = -np.inf
        at = gain.argmax(axis=1)
        top = gain[each, at]
        better = top > best
        best[better], feature[better], cut[better] = top[better], f, at[better]
    return total, best, feature, cut


def _ordered_splits(cols, sums, orders, node, sizes):
    """As :func:`_counted_splits`, for rows that lie by (node, bin) in each order."""
    k = len(sizes)
    ends = np.cumsum(sizes)
    total = [np.add.reduceat(v[orders[0]], ends - sizes) for v in sums]
    impurity = _variance_of(*total)
    best, feature, cut = np.zeros(k), np.full(k, -1), np.zeros(k, dtype="int64")
    inner = np.ones(len(node), dtype=bool)
    inner[ends - 1] = False
    for f, (c, o) in enumerate(zip(cols, orders)):
        b = c[o]
        at = np.flatnonzero((b[1:] != b[:-1]) & inner[:-1])
        if not len(at):
            continue
        own = node[at]
        left = []
        for v in sums:
            run = np.cumsum(v[o])
            left.append(run[at] - np.concatenate(([0.0], run[ends[:-1] - 1]))[own])
        gain = _gain([t[own] for t in total], impurity[own], left)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        top = np.maximum.reduceat(gain, first)
        tops = np.flatnonzero(gain == np.repeat(top, np.diff(first, append=len(own))))
        where = at[tops[np.flatnonzero(np.diff(own[tops], prepend=-1))]]
        nodes = own[first]
        better = top > best[nodes]
        x = nodes[better]
        best[x], feature[x], cut[x] = top[better], f, b[where[better]]
    return total, best, feature, cut


def _variance_of(n, s, q):
    return (q - s * s / n) / n


def _tree(bag: DataFrame, n: int, features: list[str], max_depth: int, max_bins: int, seed: int) -> np.ndarray:
    """Importances of one tree, with sum 1 (all 0 without a split)."""
    data = VectorAssembler(inputCols=features, outputCol="features").transform(bag)
    top = min(max_depth, max(1, math.ceil(math.log2(n / NODE_ROWS)) + 1))
    while True:
        model = DecisionTreeRegressor(maxDepth=top, maxBins=max_bins, seed=seed, leafCol="leaf").fit(data)
        # rows with the same bins in all features never part: one row with their sums
        rows = model.transform(data).groupBy("leaf", *features).agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").alias("s"),
            F.sum(F.col("label") * F.col("label")).alias("q"))
        if n <= MOST_NODE_ROWS or top == max_depth:
            break
        if rows.groupBy("leaf").count().agg(F.max("count")).first()[0] <= MOST_NODE_ROWS:
            break
        top = min(max_depth, top + 4)

    depth = max_depth - top

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        nsq = [pdf[c].to_numpy() for c in ("n", "s", "q")]
        gains = subtree_gains(pdf[features].to_numpy(), *nsq, depth)
        return pd.DataFrame({"gains": [gains], **{c: [v.sum()] for c, v in zip(("n", "s", "q"), nsq)}})

    if depth:
        # few bytes, much work: dealt by the rows, not by AQE's bytes a task
        rows = rows.repartition(math.ceil(n / (4 * NODE_ROWS)), "leaf")
        nodes = rows.groupBy("leaf").applyInPandas(finish, "gains array<double>, n double, s double, q double")
    else:
        nodes = rows.groupBy("leaf").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).withColumn(
            "gains", F.array(*[F.lit(0.0) for _ in features]))
    error = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    got = nodes.agg(*[F.sum(F.col("gains")[i]).alias(f"g{i}") for i in range(len(features))],
                    *[F.sum(c).alias(c) for c in ("n", "s", "q")], F.sum(error).alias("left")).first()
    # MLlib's levels: their share of the features, times what they took off the error
    above = max(got["q"] - got["s"] * got["s"] / got["n"] - got["left"], 0.0)
    gains = model.featureImportances.toArray() * above + np.array([got[f"g{i}"] for i in range(len(features))])
    return gains / gains.sum() if gains.sum() > 0 else gains


def _draws(table: DataFrame, features: list[str], n_trees: int, seed: int) -> DataFrame:
    """(tree, n, bins, times, labels): the draws of the trees, packed; a row
    that was drawn several times in turn is there once with its count."""
    draws = [table.sample(True, 1.0, seed + t).select(F.lit(t).alias("tree"), *[F.col(f"`{f}`") for f in features], "label")
             for t in range(n_trees)]
    while len(draws) > 1:
        draws = [a.union(b) for a, b in zip(draws[::2], draws[1::2])] + draws[len(draws) // 2 * 2:]

    def pack(frames):
        for pdf in frames:
            if len(pdf):
                x = np.column_stack([pdf[c].to_numpy() for c in features]).astype("int16")
                y = pdf["label"].to_numpy(dtype="float64")
                new = np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1) | (y[1:] != y[:-1])))
                at = np.flatnonzero(new)
                times = np.diff(at, append=len(y)).astype("int32")
                kind = "uint8" if x.min() >= 0 and x.max() < 256 else "int16"
                yield pd.DataFrame({"tree": pdf["tree"].iloc[:1], "n": [len(at)], "bins": [x[at].astype(kind).tobytes()],
                                    "times": [times.tobytes()], "labels": [y[at].tobytes()]})

    return draws[0].mapInPandas(pack, "tree int, n int, bins binary, times binary, labels binary")


def _forest(draws: DataFrame, known: list[str], features: list[str], n_trees: int, max_depth: int) -> np.ndarray:
    """Sum of the trees' importances over ``features``, each tree grown by one
    task from the draws of the columns ``known``."""
    p, use = len(known), [known.index(f) for f in features]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = np.concatenate([np.frombuffer(b, "uint8" if len(b) == n * p else "int16").reshape(n, p)[:, use]
                               for n, b in zip(pdf["n"], pdf["bins"])])
        times = np.concatenate([np.frombuffer(b, "int32") for b in pdf["times"]]).astype("float64")
        y = np.concatenate([np.frombuffer(b, "float64") for b in pdf["labels"]])
        gains = subtree_gains(bins, times, times * y, times * y * y, max_depth)
        return pd.DataFrame({"gains": [gains / gains.sum() if gains.sum() > 0 else gains]})

    # few bytes, much work: more partitions than trees, so that few trees share one
    grown = draws.repartition(4 * n_trees, "tree").groupBy("tree").applyInPandas(grow, "gains array<double>").collect()
    return np.sum([r["gains"] for r in grown], axis=0) if grown else np.zeros(len(use))  # a few numbers per tree


def regression_importances(table: DataFrame, features: list[str], n_trees: int = 1, max_depth: int = 30,
                           max_bins: int = 256, seed: int = 42) -> np.ndarray:
    """Importances of a regression tree over the columns ``features`` of a
    :func:`binned` table, or of a forest that considers every feature at each
    split: each of its trees has its own draw of as many rows, with replacement."""
    n = table.count()
    if n_trees == 1:
        return _tree(table, n, features, max_depth, max_bins, seed)
    if n <= MOST_TREE_ROWS:
        total = _forest(_draws(table, features, n_trees, seed), features, features, n_trees, max_depth)
        return total / total.sum() if total.sum() > 0 else total

    def one(t: int) -> np.ndarray:
        bag = table.sample(True, 1.0, seed + t)
        if n < 50 and bag.isEmpty():  # a draw from a handful of rows may be empty
            return np.zeros(len(features))
        return _tree(bag, n, features, max_depth, max_bins, seed + t)

    with ThreadPool(min(TREES_AT_A_TIME, n_trees)) as pool:
        total = np.sum(pool.map(inheritable_thread_target(table.sparkSession)(one), range(n_trees), chunksize=1), axis=0)
    return total / total.sum() if total.sum() > 0 else total


def forest_rounds(table: DataFrame, features: list[str], n_trees: int, max_depth: int = 30, max_bins: int = 256,
                  seed: int = 42):
    """``importances(columns)`` of forests over some of ``features`` of a
    :func:`binned` table; the draws, which are the same each time, are written
    once."""
    if table.count() > MOST_TREE_ROWS:
        return lambda cols: regression_importances(table, cols, n_trees, max_depth, max_bins, seed)
    draws = write_once(_draws(table, features, n_trees, seed), "tree-draws")

    def importances(cols: list[str]) -> np.ndarray:
        total = _forest(draws, features, cols, n_trees, max_depth)
        return total / total.sum() if total.sum() > 0 else total

    return importances


def fitted_importances(data: DataFrame, features: list[str], n_trees: int = 1, max_depth: int = 30,
                       max_bins: int = 256, seed: int = 42) -> np.ndarray:
    """:func:`regression_importances` of an assembled table."""
    table = binned(data, features, max_bins, seed)
    out = regression_importances(table, features, n_trees, max_depth, max_bins, seed)
    drop_written(table)
    return out

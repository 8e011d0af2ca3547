"""Feature selection: variance and correlation filters (exact), importance
ranking and top-k, tree / forest importances and recursive elimination
(MLlib), and the cross-method membership / consensus tables.

The filters decide on p or p² scalars produced by one aggregation each; the
data itself never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.operators.quality import numeric_columns
from retentio.operators.stats import correlation_pairs, variance
from retentio.schemas import LEAK_COLUMN, TARGET

# Deep trees (unlimited depth maps to Spark's maximum of 30): keep node ids
# cached between levels and give each pass more nodes, so a deep level does
# not cost a pass over the data per small group of nodes.
# Every task holds its own statistics of a node group: 256 MB each.
DEEP_TREE = dict(cacheNodeIds=True, maxMemoryInMB=256)

VARIANCE_THRESHOLD = 0.01
CORRELATION_THRESHOLD = 0.9


class SelectionError(ValueError):
    pass


def candidate_features(df: DataFrame, target: str = TARGET,
                       drop: tuple[str, ...] = (LEAK_COLUMN,)) -> list[str]:
    """Numeric columns other than the target and the dropped ones."""
    return [c for c in numeric_columns(df) if c != target and c not in drop]


def variance_report(df: DataFrame, features: list[str],
                    threshold: float = VARIANCE_THRESHOLD) -> DataFrame:
    """(feature, ordinal, variance, selected): selected iff variance > threshold."""
    v = variance(df, features)
    return v.withColumn("selected", F.coalesce(F.col("variance") > threshold, F.lit(False)))


def correlation_report(df: DataFrame, features: list[str],
                       threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """(feature, ordinal, max_abs_corr, dropped): a column is dropped when any
    *earlier* column has |r| > threshold with it, whether or not that earlier
    column is itself dropped (not greedy). NULL r never drops."""
    pairs = correlation_pairs(df, features)
    worst = pairs.groupBy(F.col("feature_b").alias("feature")).agg(
        F.max(F.abs("corr")).alias("max_abs_corr"))
    spark = df.sparkSession
    feats = spark.createDataFrame(list(enumerate(features)), "ordinal int, feature string")
    return (feats.join(worst, "feature", "left")
            .select("feature", "ordinal", "max_abs_corr",
                    F.coalesce(F.col("max_abs_corr") > threshold, F.lit(False)).alias("dropped")))


def _chosen(report: DataFrame, flag: str, keep_when: bool) -> list[str]:
    # p rows (one per feature): small driver decision.
    return [r["feature"] for r in report.orderBy("ordinal").collect() if bool(r[flag]) == keep_when]


def variance_filter(df: DataFrame, features: list[str], threshold: float = VARIANCE_THRESHOLD):
    kept = _chosen(variance_report(df, features, threshold), "selected", True)
    if not kept:
        raise SelectionError(f"no feature has variance above {threshold}")
    return kept


def correlation_filter(df: DataFrame, features: list[str],
                       threshold: float = CORRELATION_THRESHOLD):
    if len(features) < 2:
        return list(features)
    return _chosen(correlation_report(df, features, threshold), "dropped", False)


def filter_selection_report(df: DataFrame, target: str = TARGET,
                            variance_threshold: float = VARIANCE_THRESHOLD,
                            correlation_threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """Leak drop → numeric → variance filter → correlation filter on the
    survivors. One row per candidate feature with both decisions."""
    from retentio.session import write_once
    feats = candidate_features(df, target)
    # both filters read these columns: the source behind them runs once
    df = write_once(df.select(*feats), "candidates")
    vr = variance_report(df, feats, variance_threshold)
    kept = _chosen(vr, "selected", True)
    if not kept:
        raise SelectionError(f"no feature has variance above {variance_threshold}")
    cr = correlation_report(df, kept, correlation_threshold).select(
        "feature", "max_abs_corr", "dropped")
    return (vr.join(cr, "feature", "left")
            .select("feature", "ordinal", F.round("variance", 6).alias("variance"),
                    F.col("selected").alias("passes_variance"),
                    F.round("max_abs_corr", 6).alias("max_abs_corr"),
                    (F.col("selected") & ~F.coalesce(F.col("dropped"), F.lit(False))).alias("selected")))


def filter_selection(df: DataFrame, target: str = TARGET, **kw) -> tuple[DataFrame, list[str]]:
    """Selected dataset (chosen columns + target) and the chosen list."""
    from retentio.session import write_once
    df = write_once(df, "training")
    rep = filter_selection_report(df, target, **kw)
    chosen = _chosen(rep, "selected", True)
    return df.select(*chosen, target), chosen


# --- importance tables -----------------------------------------------------

def importance_table(spark, features: list[str], importances) -> DataFrame:
    """(feature, importance, ordinal) from p driver-side scalars."""
    rows = [(f, float(v), i) for i, (f, v) in enumerate(zip(features, importances))]
    return spark.createDataFrame(rows, "feature string, importance double, ordinal int")


def rank_importance(imp: DataFrame) -> DataFrame:
    """Descending importance, ties in column order; adds ``rank`` (1-based).
    The table has one row per feature, so one window over it is small."""
    if "ordinal" not in imp.columns:
        raise ValueError("importance table needs an 'ordinal' column for tie-breaks")
    w = Window.orderBy(F.desc("importance"), F.asc("ordinal"))
    return imp.withColumn("rank", F.row_number().over(w))


def select_top_k(imp: DataFrame, k: int | None = None, min_importance: float | None = None) -> DataFrame:
    """Top-k after ranking, or every feature with importance >= threshold."""
    if k is None and min_importance is None:
        raise ValueError("give k or min_importance")
    ranked = rank_importance(imp)
    if k is not None:
        return ranked.where(F.col("rank") <= k)
    return ranked.where(F.col("importance") >= min_importance)


def selection_membership(sets: DataFrame, methods: list[str]) -> DataFrame:
    """Long (method, feature) → one row per feature with a 0/1 column per method."""
    return (sets.groupBy("feature").pivot("method", methods).agg(F.count(F.lit(1)))
            .na.fill(0, subset=methods)
            .select("feature", *[F.least(F.col(m), F.lit(1)).cast("int").alias(m) for m in methods]))


def selection_consensus(sets: DataFrame, min_methods: int = 3) -> DataFrame:
    """Features chosen by at least ``min_methods`` methods."""
    return (sets.groupBy("feature").agg(F.count_distinct("method").alias("n_methods"))
            .where(F.col("n_methods") >= min_methods))


# --- model-based importances (MLlib) ---------------------------------------

def _assembled(df: DataFrame, features: list[str], target: str):
    """Model input, written once and dealt out by the row's values: fits read
    it again and again, and depend on the rows alone, not on how they came."""
    from retentio.operators.model import assemble
    from retentio.session import write_once
    cols = [*features, target]
    d = df.select(*cols).repartition(*cols).sortWithinPartitions(*cols)  # few rows: few partitions
    return assemble(write_once(d, "tree-input"), features, target)


def tree_importance(df: DataFrame, target: str = TARGET, task: str = "classification",
                    max_depth: int = 30, max_bins: int = 256, seed: int = 42,
                    features: list[str] | None = None) -> DataFrame:
    """Decision-tree impurity importances, ranked."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from retentio.operators.trees import fitted_importances
    if task not in ("classification", "regression"):
        raise ValueError(f"unsupported task: {task}")
    features = features or candidate_features(df, target, drop=())
    data = _assembled(df, features, target)
    if task == "classification":
        model = DecisionTreeClassifier(maxDepth=max_depth, maxBins=max_bins, seed=seed, **DEEP_TREE).fit(data)
        weights = model.featureImportances.toArray()
    else:
        weights = fitted_importances(data, features, 1, max_depth, max_bins, seed)
    return rank_importance(importance_table(df.sparkSession, features, weights))


def forest_importance(df: DataFrame, target: str = TARGET, task: str = "classification",
                      n_trees: int = 100, max_depth: int = 30, max_bins: int = 256,
                      seed: int = 42, features: list[str] | None = None) -> DataFrame:
    """Random-forest impurity importances, ranked. The regressor considers
    every feature at each split."""
    from pyspark.ml.classification import RandomForestClassifier
    from retentio.operators.trees import fitted_importances
    if task not in ("classification", "regression"):
        raise ValueError(f"unsupported task: {task}")
    features = features or candidate_features(df, target, drop=())
    data = _assembled(df, features, target)
    if task == "classification":
        est = RandomForestClassifier(numTrees=n_trees, maxDepth=max_depth, maxBins=max_bins,
                                     featureSubsetStrategy="sqrt", seed=seed, **DEEP_TREE)
        weights = est.fit(data).featureImportances.toArray()
    else:
        weights = fitted_importances(data, features, n_trees, max_depth, max_bins, seed)
    return rank_importance(importance_table(df.sparkSession, features, weights))


def _estimators(n: int, seed: int) -> dict:
    """(task, estimator) → a fresh estimator and how to read its weights."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.regression import LinearRegression

    def importances(m):
        return list(m.featureImportances.toArray())

    def squares(m):
        return [float(x) ** 2 for x in m.coefficients.toArray()]

    return {
        ("classification", "rf"): (lambda: RandomForestClassifier(
            numTrees=100, maxDepth=30, maxBins=256, featureSubsetStrategy="sqrt", seed=seed, **DEEP_TREE), importances),
        ("classification", "logistic"): (lambda: LogisticRegression(
            maxIter=5000, regParam=1.0 / n, elasticNetParam=0.0, standardization=False), squares),
        ("regression", "linear"): (lambda: LinearRegression(regParam=0.0), squares),
    }


def _round_weights(est_name: str, task: str, base: DataFrame, features: list[str], n: int, seed: int):
    """``weights(columns)`` of one round over the written input."""
    from pyspark.ml.feature import VectorAssembler
    known = _estimators(n, seed)
    if (task, est_name) == ("regression", "rf"):
        from retentio.operators.trees import binned, forest_rounds
        table = binned(VectorAssembler(inputCols=features, outputCol="features").transform(base), features, seed=seed)
        return forest_rounds(table, features, n_trees=100, seed=seed)
    if (task, est_name) not in known:
        raise ValueError(f"no {est_name!r} estimator for {task}; known: {sorted([*known, ('regression', 'rf')])}")
    make, read = known[(task, est_name)]
    return lambda cols: read(make().fit(VectorAssembler(inputCols=cols, outputCol="features").transform(base)))


def rfe(df: DataFrame, n_features: int, target: str = TARGET, task: str = "classification",
        estimator: str = "rf", seed: int = 42, features: list[str] | None = None) -> DataFrame:
    """Recursive elimination, one feature per round: (feature, ordinal,
    ranking, selected). Kept features rank 1, the last dropped 2, the first
    dropped p - k + 1. Ties drop the lower ordinal first. Each round is one
    distributed fit on the cached input."""
    features = features or candidate_features(df, target, drop=())
    p = len(features)
    if n_features > p:
        raise ValueError(f"n_features={n_features} exceeds the {p} available features")
    from retentio.session import write_once
    cols = [*features, target]
    d = df.select(*cols).repartition(*cols).sortWithinPartitions(*cols)
    base = write_once(d.select(
        *[F.col(c).cast("double") for c in features], F.col(target).cast("double").alias("label")), "rfe-input")
    n = base.count()
    remaining = list(features)
    ranking = {}
    rank = p - n_features + 1
    weights = _round_weights(estimator, task, base, features, n, seed) if len(remaining) > n_features else None
    while len(remaining) > n_features:
        w = weights(list(remaining))
        weakest = min(range(len(remaining)), key=lambda i: (w[i], features.index(remaining[i])))
        ranking[remaining.pop(weakest)] = rank
        rank -= 1
    for f in remaining:
        ranking[f] = 1
    rows = sorted(((f, i, ranking[f], ranking[f] == 1) for i, f in enumerate(features)), key=lambda r: (r[2], r[1]))
    return df.sparkSession.createDataFrame(
        rows, "feature string, ordinal int, ranking int, selected boolean")

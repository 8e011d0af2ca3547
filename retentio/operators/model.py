"""Model matrix, forest training, cross-validation and persistence (MLlib).

The ranked training input is written once per training call to the
checkpoint folder; every fold, the fit and the hold-out scoring read it.
Inputs are repartitioned by the row key before fitting, because MLlib
forests are deterministic only for a fixed partitioning."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.operators.evaluation import classification_report, confusion_matrix, roc_auc
from retentio.operators.split import stratified_folds, stratified_split, with_class_weights
from retentio.schemas import ID_COLUMNS, LEAKY_COLUMNS, TARGET
from retentio.session import checkpoint_dir, write_once

# Forest defaults of the training step.
FOREST_DEFAULTS = dict(n_trees=200, max_depth=10, min_leaf=5, seed=42)
LEAKAGE_ACCURACY = 0.98


def model_matrix(df: DataFrame, target: str = TARGET, leaky=tuple(LEAKY_COLUMNS),
                 ids=tuple(ID_COLUMNS), keep_ids: bool = True) -> DataFrame:
    """Drop leaky columns, drop rows without a target, cast the target to
    int. Ids are kept (as row keys) unless ``keep_ids`` is False."""
    out = df.drop(*[c for c in leaky if c in df.columns])
    if not keep_ids:
        out = out.drop(*[c for c in ids if c in out.columns])
    return (out.where(F.col(target).isNotNull())
            .withColumn(target, F.col(target).cast("int")))


def feature_list(df: DataFrame, target: str = TARGET, ids=tuple(ID_COLUMNS)) -> list[str]:
    from retentio.operators.quality import numeric_columns
    return [c for c in numeric_columns(df) if c != target and c not in ids
            and c not in ("weight", "fold", "is_test")]


def assemble(df: DataFrame, features: list[str], target: str = TARGET,
             label_col: str = "label") -> DataFrame:
    data = VectorAssembler(inputCols=features, outputCol="features",
                           handleInvalid="error").transform(df)
    return data.withColumn(label_col, F.col(target).cast("double"))


def forest(n_trees=200, max_depth=10, min_leaf=5, seed=42, max_bins=256,
           weight_col: str | None = "weight") -> RandomForestClassifier:
    # 1 GiB of split statistics per pass lets one pass over the data grow
    # many more nodes of the 200 trees than the 256 MiB default
    est = RandomForestClassifier(numTrees=n_trees, maxDepth=min(max_depth or 30, 30),
                                 minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt",
                                 seed=seed, maxBins=max_bins, labelCol="label",
                                 featuresCol="features", maxMemoryInMB=1024)
    if weight_col:
        est = est.setWeightCol(weight_col)
    return est


def fit_forest(train: DataFrame, features: list[str], target: str = TARGET,
               **params) -> PipelineModel:
    """Balanced-weight forest on ``train`` (weights from these rows)."""
    weighted = with_class_weights(train, target).withColumn("label", F.col(target).cast("double"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features",
                                            handleInvalid="error"),
                            forest(**{**FOREST_DEFAULTS, **params})])
    return pipe.fit(weighted)


def positive_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("score", vector_to_array(F.col("probability"))[1])


def threshold_rule(feature: str, target: str = TARGET):
    """A one-column baseline as a ``fit`` of :func:`fold_scores`: class 1 above
    the column's mean over the training rows (6 places), score = the column."""
    def fit(train: DataFrame):
        mean = train.agg(F.round(F.avg(F.col(feature).cast("double")), 6)).first()[0]
        x = F.col(feature).cast("double")
        return lambda df: df.withColumn("score", x).withColumn("prediction", (x > F.lit(mean)).cast("double"))
    return fit


def forest_rule(features: list[str], target: str = TARGET, **params):
    """The class-weighted forest as a ``fit`` of :func:`fold_scores`."""
    def fit(train: DataFrame):
        model = fit_forest(train, features, target, **params)
        return lambda df: positive_probability(model, df)
    return fit


def fold_scores(df: DataFrame, fit, target: str = TARGET, key: str = "login", k: int = 5, seed: int = 42,
                parallelism: int = 1) -> DataFrame:
    """Predictions of k stratified folds, each fitted without its own rows:
    (fold, split 'train' or 'validation', target, prediction, score), all rows
    per fold, written once.

    ``fit(train)`` returns a function that adds ``prediction`` and ``score``.
    The folds share one written input; ``parallelism`` of them are fitted at a
    time, so that one fold's small driver-side steps do not leave the cluster
    idle (each needs its own memory for the fit). The scores do not depend on it.
    """
    checkpoint_dir(df.sparkSession)
    # written to the checkpoint folder: every fold reads it instead of
    # recomputing the ranked input, and a lost executor does not lose it
    data = stratified_folds(df, target, key, k, seed).repartition(key).checkpoint(eager=True)

    def one(f: int) -> DataFrame:
        score = fit(data.where(F.col("fold") != f))
        split = F.when(F.col("fold") == f, "validation").otherwise("train")
        own = data.withColumn("_split", split).drop("fold")
        return score(own).select(F.lit(f).alias("fold"), F.col("_split").alias("split"), target, "prediction", "score")

    if parallelism > 1:
        with ThreadPool(min(parallelism, k)) as pool:
            scored = pool.map(inheritable_thread_target(df.sparkSession)(one), range(k))
    else:
        scored = [one(f) for f in range(k)]
    return write_once(reduce(DataFrame.unionByName, scored), "cv-scores")


def fold_metrics(scores: DataFrame, target: str = TARGET) -> DataFrame:
    """Per fold and split: tp, fp, fn, tn, accuracy, f1 (class 1) and roc_auc
    (NULL with a single class). One confusion job and one AUC for all."""
    by = ["fold", "split"]
    conf = write_once(confusion_matrix(scores, target, "prediction", by), "confusion")

    def cell(label, prediction):
        return F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("prediction") == prediction), F.col("n"))), F.lit(0))

    counts = conf.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    report = classification_report(conf, by, places=None).groupBy(*by).agg(
        F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.max(F.when(F.col("class") == "1", F.col("f1"))).alias("f1"))
    auc = roc_auc(scores, target, "score", by).select(*by, "roc_auc")
    return counts.join(report, by).join(auc, by, "left")


def cross_validate(df: DataFrame, features: list[str], target: str = TARGET, key: str = "login",
                   k: int = 5, seed: int = 42, parallelism: int = 1, fit=None, **params) -> DataFrame:
    """k stratified folds; accuracy, F1 (class 1) and ROC-AUC on the train and
    validation part of every fold → (metric, split, mean, std (ddof 0),
    leakage_warning). ``fit`` replaces the forest (see :func:`fold_scores`)."""
    fit = fit or forest_rule(features, target, seed=seed, **params)
    m = fold_metrics(fold_scores(df, fit, target, key, k, seed, parallelism), target)
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v"))
                                 for c in ("accuracy", "f1", "roc_auc")]))
    return m.select("split", values.alias("x")).groupBy(F.col("x.metric").alias("metric"), "split").agg(
        F.avg("x.v").alias("mean"), F.stddev_pop("x.v").alias("std")).withColumn(
        "leakage_warning", F.coalesce((F.col("metric") == "accuracy") & (F.col("mean") > LEAKAGE_ACCURACY), F.lit(False)))


def train_forest(df: DataFrame, features: list[str] | None = None, target: str = TARGET,
                 key: str = "login", test_size: float = 0.2, seed: int = 42, **params):
    """Exact stratified hold-out, forest on the train part, hold-out
    predictions. Returns (model, holdout_predictions, features)."""
    features = features or feature_list(df, target)
    checkpoint_dir(df.sparkSession)
    # the split input is ranked by several jobs and read by the fit and the
    # hold-out scoring: write it once to the checkpoint folder
    parts = stratified_split(df, target, key, test_size, seed).repartition(key).checkpoint(eager=True)
    train = parts.where(~F.col("is_test"))
    test = parts.where(F.col("is_test"))
    model = fit_forest(train, features, target, seed=seed, **params)
    return model, positive_probability(model, test), features


def holdout_report(pred: DataFrame, target: str = TARGET) -> DataFrame:
    """Class report of hold-out predictions plus the rows ``roc_auc`` and
    ``majority baseline`` (their value in every metric column) and the
    leakage warning on the accuracy."""
    pred = write_once(pred.select(target, "prediction", "score"), "holdout")
    rep = classification_report(confusion_matrix(pred, target, "prediction"))
    rep = rep.withColumn("leakage_warning", (F.col("class") == "accuracy") & (F.col("f1") > LEAKAGE_ACCURACY))
    n = pred.groupBy(F.col(target)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    base = n.select(F.lit("majority baseline").alias("class"), F.round(F.col("m") / F.col("n"), 4).alias("v"), "n")
    auc = roc_auc(pred, target, "score").select(
        F.lit("roc_auc").alias("class"), F.round("roc_auc", 4).alias("v"), (F.col("n_pos") + F.col("n_neg")).alias("n"))
    more = auc.unionByName(base).select("class", *[F.col("v").alias(c) for c in ("precision", "recall", "f1")],
                                        F.col("n").cast("long").alias("support"), F.lit(False).alias("leakage_warning"))
    return rep.unionByName(more)


def model_importance(model: PipelineModel, features: list[str], k: int = 10) -> DataFrame:
    from pyspark.sql import SparkSession
    from retentio.operators.selection import importance_table, select_top_k
    spark = SparkSession.getActiveSession()
    imp = importance_table(spark, features, model.stages[-1].featureImportances.toArray())
    return select_top_k(imp, k=k)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_features(model: PipelineModel) -> list[str]:
    """The feature list travels with the model (assembler input columns)."""
    return list(model.stages[0].getInputCols())

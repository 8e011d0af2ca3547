"""Classification metrics from (label, prediction, score) tables.

Everything derives from the confusion counts (one small aggregation) or,
for ROC-AUC, from per-score class counts with exact running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.operators.ordering import range_bucketed, running_sums


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: list[str] | None = None) -> DataFrame:
    by = by or []
    return pred.groupBy(*by, F.col(label).cast("int").alias("label"),
                        F.col(prediction).cast("int").alias("prediction")) \
               .agg(F.count(F.lit(1)).alias("n"))


def classification_report(confusion: DataFrame, by: list[str] | None = None,
                          classes=(0, 1), places: int | None = 4) -> DataFrame:
    """Per class precision / recall / F1 / support, then accuracy, macro and
    weighted averages (0/0 → 0), rounded to ``places`` (None: not at all).

    Rows: ``class`` = '0', '1', 'accuracy', 'macro avg', 'weighted avg'.
    """
    by = by or []
    g = confusion.groupBy(*by)
    aggs = []
    for c in classes:
        aggs += [F.sum(F.when((F.col("label") == c) & (F.col("prediction") == c), F.col("n"))
                       .otherwise(0)).alias(f"tp{c}"),
                 F.sum(F.when(F.col("prediction") == c, F.col("n")).otherwise(0)).alias(f"pp{c}"),
                 F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"sup{c}")]
    aggs.append(F.sum("n").alias("total"))
    t = g.agg(*aggs)

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    per = []
    for c in classes:
        p = ratio(F.col(f"tp{c}"), F.col(f"pp{c}"))
        r = ratio(F.col(f"tp{c}"), F.col(f"sup{c}"))
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        per.append((str(c), p, r, f, F.col(f"sup{c}")))
    acc = ratio(sum(F.col(f"tp{c}") for c in classes), F.col("total"))
    n_cls = float(len(classes))
    macro = [sum(x[i] for x in per) / n_cls for i in (1, 2, 3)]
    weighted = [ratio(sum(x[i] * x[4] for x in per), F.col("total")) for i in (1, 2, 3)]
    rows = [F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                     f.alias("f1"), s.cast("long").alias("support"))
            for name, p, r, f, s in per]
    rows.append(F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"),
                         acc.alias("recall"), acc.alias("f1"), F.col("total").cast("long").alias("support")))
    rows.append(F.struct(F.lit("macro avg").alias("class"), *[m.alias(n) for m, n in
                zip(macro, ("precision", "recall", "f1"))], F.col("total").cast("long").alias("support")))
    rows.append(F.struct(F.lit("weighted avg").alias("class"), *[m.alias(n) for m, n in
                zip(weighted, ("precision", "recall", "f1"))], F.col("total").cast("long").alias("support")))
    out = t.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")
    if places is None:
        return out
    return out.select(*by, "class", *[F.round(c, places).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score",
            by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC per group = P(s+ > s-) + ½·P(s+ = s-) (rank-sum with
    average ranks on ties). NULL when a group has only one class.

    Scores are first reduced to per-(group, score) class counts, written once
    in quantile ranges of (group, score); the number of negatives below each
    score is an exact running sum over these ranges.
    """
    by = by or []
    s = F.col(score).cast("double")
    agg = (scored.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull())
           .groupBy(*by, s.alias("_s"))
           .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")))
    b = range_bucketed(agg, [*by, "_s"], "_b", buckets)
    r = running_sums(b, by, "_b", [F.col("_s")], {"_neg": F.col("_neg")})
    contrib = F.col("_pos") * (F.col("_neg_before") + 0.5 * F.col("_neg"))
    res = r.groupBy(*by).agg(F.sum(contrib).alias("_u"), F.sum("_pos").alias("n_pos"),
                             F.sum("_neg").alias("n_neg"))
    return res.select(*by, "n_pos", "n_neg",
                      F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                             F.round(F.col("_u") / (F.col("n_pos") * F.col("n_neg")), 6))
                      .alias("roc_auc"))


def feature_auc(df: DataFrame, features: list[str], label: str = "churn",
                leak_threshold: float = 0.98) -> DataFrame:
    """Single-feature ROC-AUC of every feature against the label, and a leak
    flag when max(auc, 1 - auc) exceeds ``leak_threshold``."""
    long = df.select(F.col(label), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score"))
        for f in features])).alias("x")).select(label, "x.feature", "x.score")
    auc = roc_auc(long, label, "score", by=["feature"])
    return auc.select("feature", "roc_auc",
                      (F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc")) > leak_threshold)
                      .alias("leak_suspect"))


def accuracy_flag(metrics: DataFrame, column: str = "accuracy", threshold: float = 0.98) -> DataFrame:
    """Leakage warning: accuracy above ``threshold`` is implausible."""
    return metrics.withColumn("leakage_warning", F.col(column) > threshold)

"""Fold metrics against a loop, and folds fitted side by side."""

import random
import statistics

from pyspark.sql import functions as F

from retentio.operators import model as md


def table(spark, n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        rows.append((f"u{i}", round(rng.gauss(y, 1.2), 2), round(rng.random(), 3), y))
    return spark.createDataFrame(rows, "login string, a double, b double, churn int")


def auc(rows):
    pos, neg = [s for y, _, s in rows if y], [s for y, _, s in rows if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_fold_metrics_match_a_loop(spark):
    scores = md.fold_scores(table(spark), md.threshold_rule("a"), k=4)
    rows = [(r.fold, r.split, r.churn, int(r.prediction), r.score) for r in scores.collect()]
    assert len(rows) == 4 * 240
    got = {(r.fold, r.split): r for r in md.fold_metrics(scores).collect()}
    assert len(got) == 8
    for (fold, split), m in got.items():
        own = [(y, p, s) for f, x, y, p, s in rows if (f, x) == (fold, split)]
        tp, fp = sum(y == p == 1 for y, p, _ in own), sum(p == 1 and y == 0 for y, p, _ in own)
        fn, tn = sum(p == 0 and y == 1 for y, p, _ in own), sum(y == p == 0 for y, p, _ in own)
        assert (m.tp, m.fp, m.fn, m.tn) == (tp, fp, fn, tn)
        assert abs(m.accuracy - (tp + tn) / len(own)) < 1e-12
        assert abs(m.f1 - 2 * tp / (2 * tp + fp + fn)) < 1e-12
        assert abs(m.roc_auc - auc(own)) < 1e-6  # rounded to 6 places
    cv = {(r.metric, r.split): r for r in md.cross_validate(table(spark), [], k=4, fit=md.threshold_rule("a")).collect()}
    for split in ("train", "validation"):
        values = [m.f1 for (_, s), m in got.items() if s == split]
        assert abs(cv["f1", split].mean - statistics.mean(values)) < 1e-12
        assert abs(cv["f1", split].std - statistics.pstdev(values)) < 1e-9


def test_folds_fitted_side_by_side_score_alike(spark):
    def run(parallelism):
        fit = md.forest_rule(["a", "b"], n_trees=8, max_depth=4)
        s = md.fold_scores(table(spark), fit, k=3, parallelism=parallelism)
        return sorted((r.fold, r.split, r.churn, r.prediction, r.score) for r in s.collect())

    assert run(1) == run(3)


def test_one_class_in_a_fold_has_no_auc(spark):
    df = table(spark, 40).withColumn("churn", F.lit(1))
    m = md.fold_metrics(md.fold_scores(df, md.threshold_rule("a"), k=2)).collect()
    assert len(m) == 4 and all(r.roc_auc is None and r.tn == r.fp == 0 for r in m)
    assert {r.metric for r in md.cross_validate(df, [], k=2, fit=md.threshold_rule("a")).collect()} == {"accuracy", "f1", "roc_auc"}

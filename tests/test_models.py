"""Model-based operators: properties, not exact values (forest RNG and
binning differ from any other implementation)."""

import pytest
from pyspark.sql import functions as F

from retentio.operators import model as md
from retentio.operators import selection as sel
from retentio.operators.scoring import batch_score

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lab(spark):
    from retentio.plans.catalog import labeled
    return labeled(spark, SF).cache()


def test_tree_importance_finds_the_leak_when_kept(spark, lab):
    # Dataset A with the leak column, the two 180-day ratios removed (T14)
    df = lab.drop("active_repo_ratio", "inactive_repo_ratio")
    imp = sel.tree_importance(df, max_bins=256)
    top = imp.orderBy("rank").first()
    assert top.feature == "days_since_last_activity" and top.importance > 0.99
    total = imp.agg(F.sum("importance")).first()[0]
    assert total == pytest.approx(1.0, abs=1e-9)


def test_leak_absent_from_training_importances(spark, lab):
    from retentio.operators.labels import training_dataset
    imp = sel.forest_importance(training_dataset(lab), n_trees=20)
    assert "days_since_last_activity" not in {r.feature for r in imp.collect()}
    assert imp.agg(F.sum("importance")).first()[0] == pytest.approx(1.0, abs=1e-9)


def test_rfe_rank_structure(spark, lab):
    from retentio.operators.labels import training_dataset
    out = sel.rfe(training_dataset(lab), 6, estimator="logistic").collect()
    ranks = sorted(r.ranking for r in out)
    assert ranks == [1] * 6 + [2, 3, 4]
    with pytest.raises(ValueError):
        sel.rfe(training_dataset(lab), 20)


def test_accuracy_warning_fires_with_same_window_feature(spark, lab):
    # repo_activity_density shares the label's 180-day window (T17)
    m = md.model_matrix(lab)
    model, pred, feats = md.train_forest(m, n_trees=20)
    assert "repo_activity_density" in feats
    rep = {r["class"]: r for r in md.holdout_report(pred).collect()}
    assert rep["accuracy"].f1 > 0.98 and rep["accuracy"].leakage_warning


def test_realistic_model_metrics_are_bounded(spark, lab):
    m = md.model_matrix(lab, leaky=md.LEAKY_COLUMNS + ["repo_activity_density"])
    model, pred, feats = md.train_forest(m, n_trees=20)
    from retentio.operators.evaluation import roc_auc
    auc = roc_auc(pred, "churn", "score").first().roc_auc
    assert 0.0 <= auc <= 1.0
    assert pred.count() == 300


def test_model_roundtrip_scores_identically(spark, lab, tmp_path):
    m = md.model_matrix(lab)
    model, _, _ = md.train_forest(m, n_trees=10)
    path = md.save_model(model, str(tmp_path / "model"))
    back = md.load_model(path)
    assert md.model_features(back) == md.model_features(model)
    from retentio.plans.catalog import features
    f = features(spark, SF)
    a = batch_score(model, f)
    b = batch_score(back, f)
    assert a.exceptAll(b).count() == 0
    row = a.first()
    assert row.risk_tier in ("low", "medium", "high") and row.churn_percentage.endswith("%")


def test_cross_validate_reports_train_and_validation(spark, lab):
    m = md.model_matrix(lab, leaky=md.LEAKY_COLUMNS + ["repo_activity_density"])
    cv = md.cross_validate(m, md.feature_list(m), k=3, n_trees=10).collect()
    keys = {(r.metric, r.split) for r in cv}
    assert keys == {(x, s) for x in ("accuracy", "f1", "roc_auc") for s in ("train", "validation")}
    assert all(0.0 <= r.mean <= 1.0 and r.std >= 0.0 for r in cv)


def test_scores_from_landed_records_equal_table_scores(spark):
    """Train/serve parity: one feature function for both routes."""
    from retentio.operators.features import features_from_records
    from retentio.plans.catalog import features, labeled
    from retentio.plans.ingest_queries import landed_json
    from retentio.sources import tables
    sf = "/root/testdata/sf0.001"
    model, _, _ = md.train_forest(md.model_matrix(labeled(spark, sf)), n_trees=10)
    a = batch_score(model, features(spark, sf))
    b = batch_score(model, features_from_records(landed_json(spark, sf), tables.ORDERS_AS_OF))
    assert a.count() == 150
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

"""Catalog entries for model-based operators (MLlib): tree / forest
importances, recursive elimination, selection membership, training,
cross-validation, persistence and batch scoring. These have no SQL oracle;
the tests check their properties. Also the date-parsing query."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentio.functions.dates import as_of_date, days_between, parse_date
from retentio.operators import model as md
from retentio.operators import selection as sel
from retentio.operators.scoring import batch_score
from retentio.plans.catalog import features, labeled, query, training
from retentio.session import scratch_path
from retentio.sources import tables

TOP_K = 6


@query("dt_selection")
def q_dt_selection(spark, sf):
    return sel.tree_importance(training(spark, sf))


@query("rf_selection")
def q_rf_selection(spark, sf):
    return sel.forest_importance(training(spark, sf))


@query("rfe_selection")
def q_rfe_selection(spark, sf):
    return sel.rfe(training(spark, sf), TOP_K, estimator="rf")


@query("rfe_logistic")
def q_rfe_logistic(spark, sf):
    return sel.rfe(training(spark, sf), TOP_K, estimator="logistic")


@query("rfe_linear")
def q_rfe_linear(spark, sf):
    t = training(spark, sf)
    feats = [c for c in sel.candidate_features(t, drop=()) if c != "repos_per_year"]
    return sel.rfe(t, TOP_K, target="repos_per_year", task="regression", estimator="linear",
                   features=feats)


@query("rfe_forest_regression")
def q_rfe_forest_regression(spark, sf):
    """Elimination by a regression forest for a numeric target."""
    t = training(spark, sf)
    feats = [c for c in sel.candidate_features(t, drop=()) if c != "repos_per_year"]
    return sel.rfe(t, TOP_K, target="repos_per_year", task="regression", estimator="rf", features=feats)


def selection_sets(spark, sf):
    """Long (method, feature) table of the four selectors' choices."""
    t = training(spark, sf).cache()
    _, chosen = sel.filter_selection(t)
    rows = [("filter", f) for f in chosen]
    for method, imp in (("dt", sel.tree_importance(t)), ("rf", sel.forest_importance(t))):
        rows += [(method, r["feature"]) for r in sel.select_top_k(imp, k=TOP_K).collect()]
    rows += [("rfe", r["feature"]) for r in sel.rfe(t, TOP_K).where("selected").collect()]
    t.unpersist()
    return spark.createDataFrame(rows, "method string, feature string")


@query("selection_membership")
def q_selection_membership(spark, sf):
    return sel.selection_membership(selection_sets(spark, sf), ["filter", "dt", "rf", "rfe"])


@query("selection_consensus")
def q_selection_consensus(spark, sf):
    return sel.selection_consensus(selection_sets(spark, sf), 3)


def matrix(spark, sf):
    return md.model_matrix(labeled(spark, sf))


@query("train_forest")
def q_train_forest(spark, sf):
    m = matrix(spark, sf)
    model, pred, feats = md.train_forest(m)
    return md.holdout_report(pred)


@query("cross_validate")
def q_cross_validate(spark, sf):
    m = matrix(spark, sf)
    return md.cross_validate(m, md.feature_list(m), parallelism=4)


@query("model_importance")
def q_model_importance(spark, sf):
    m = matrix(spark, sf)
    model, _, feats = md.train_forest(m)
    return md.model_importance(model, feats, 10)


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    m = matrix(spark, sf)
    model, _, _ = md.train_forest(m)
    path = md.save_model(model, scratch_path(spark, "model"))
    back = md.load_model(path)
    return batch_score(back, features(spark, sf))


@query("batch_score")
def q_batch_score(spark, sf):
    m = matrix(spark, sf)
    model, _, _ = md.train_forest(m)
    return batch_score(model, features(spark, sf))


@query("model_comparison")
def q_model_comparison(spark, sf):
    """The same hold-out scored by a forest on the forest-selected features
    and one on the filter-selected features."""
    m = matrix(spark, sf)
    t = training(spark, sf)
    rf_top = [r["feature"] for r in sel.select_top_k(sel.forest_importance(t), k=TOP_K).collect()]
    _, filtered = sel.filter_selection(t)
    out = None
    for name, feats in (("rf_selected", [f for f in rf_top if f in m.columns]),
                        ("filtered", [f for f in filtered if f in m.columns])):
        _, pred, _ = md.train_forest(m, feats)
        rep = md.holdout_report(pred).withColumn("model", F.lit(name))
        out = rep if out is None else out.unionByName(rep)
    return out


# --- date parsing over table-derived text ---------------------------------------

def date_texts(spark, sf):
    """Order dates rendered in the accepted layouts and a few rejected ones."""
    o = tables.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    fmt = F.date_format
    text = (F.when(k % 97 == 0, F.lit("garbage"))
            .when(k % 8 == 0, fmt(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(k % 8 == 1, F.concat(F.lit(" "), fmt(d, "yyyy-MM-dd"), F.lit(" 01:30:00+02:00 ")))
            .when(k % 8 == 2, fmt(d, "yyyy-MM-dd'T'HH:mm:ss"))
            .when(k % 8 == 3, fmt(d, "yyyy-MM-dd"))
            .when(k % 8 == 4, fmt(d, "yyyy-M-d"))
            .when(k % 8 == 5, F.concat(fmt(d, "yyyy-MM-dd"), F.lit("T23:30:00-03:00")))
            .when(k % 8 == 6, F.concat(fmt(d, "yyyy-MM-dd"), F.lit("T23:30:00-0300")))
            .otherwise(F.concat(fmt(d, "yyyy-MM-dd"), F.lit("T03:04:05.123Z"))))
    return o.select("o_orderkey", text.alias("text"))


@query("parse_date", """
SELECT o_orderkey, strftime(p, '%Y-%m-%d') AS parsed,
       CAST(CASE WHEN p IS NULL THEN NULL ELSE greatest(DATE '2001-08-01' - p, 0) END AS INT) AS days_to_as_of
FROM (SELECT o_orderkey,
        CASE WHEN o_orderkey % 97 = 0 THEN NULL
             WHEN o_orderkey % 8 = 1 THEN CAST(o_orderdate AS DATE) - 1
             WHEN o_orderkey % 8 IN (5, 6) THEN CAST(o_orderdate AS DATE) + 1
             WHEN o_orderkey % 8 = 7 THEN NULL
             ELSE CAST(o_orderdate AS DATE) END AS p
      FROM orders)""")
def q_parse_date(spark, sf):
    t = date_texts(spark, sf)
    p = parse_date(F.col("text"))
    return t.select("o_orderkey", F.date_format(p, "yyyy-MM-dd").alias("parsed"),
                    days_between(p, as_of_date(tables.ORDERS_AS_OF)).alias("days_to_as_of"))


@query("dt_selection_regression")
def q_dt_selection_regression(spark, sf):
    """Regression tree importances for a numeric target (account age)."""
    t = training(spark, sf)
    feats = [c for c in sel.candidate_features(t, drop=()) if c != "account_age_days"]
    return sel.tree_importance(t, target="account_age_days", task="regression", features=feats)


@query("rf_selection_regression")
def q_rf_selection_regression(spark, sf):
    """Regression forest (every feature considered at each split)."""
    t = training(spark, sf)
    feats = [c for c in sel.candidate_features(t, drop=()) if c != "account_age_days"]
    return sel.forest_importance(t, target="account_age_days", task="regression", features=feats)


@query("score_landed_users")
def q_score_landed_users(spark, sf):
    """Serving path on a whole table: landed raw records → the same feature
    function as training (nested route, all repositories) → model → score."""
    from retentio.operators.features import features_from_records
    from retentio.plans.ingest_queries import landed_json
    m = matrix(spark, sf)
    model, _, _ = md.train_forest(m)
    feats = features_from_records(landed_json(spark, sf), tables.ORDERS_AS_OF)
    return batch_score(model, feats)

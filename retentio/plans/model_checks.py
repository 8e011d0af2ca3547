"""Model queries projected onto what is exact, with SQL.

A forest's figures have no SQL form, but much about them is fixed: which rows
and classes they cover, their bounds, the rules that derive one column from
another, that ranks are permutations and importances sum to one. Each query
here runs an operator and returns these facts; the SQL states them from the
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.operators import model as md
from retentio.operators import selection as sel
from retentio.operators.scoring import batch_score, percent_text, risk_tier
from retentio.plans import model_queries as mq
from retentio.plans import oracle as o
from retentio.plans.catalog import (_ORDERED, _SPLIT_SQL, DEFECTIVE_V, TRAIN_COLS, defective, features, query,
                                    training)
from retentio.session import scratch_path
from retentio.sources import tables

_TEST = _SPLIT_SQL.replace("""
SELECT churn, false AS is_test, n_tr AS n FROM tr
UNION ALL SELECT churn, true AS is_test, n - n_tr AS n FROM tr""", """,
te AS (SELECT churn, n - n_tr AS n FROM tr)""")

_REPORT_SQL = """
SELECT class, CAST(support AS BIGINT) AS support, true AS bounded, true AS f1_follows, true AS warning_follows FROM (
  SELECT CAST(churn AS VARCHAR) AS class, n AS support FROM te
  UNION ALL SELECT c, (SELECT sum(n) FROM te) FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg'), ('roc_auc'),
    ('majority baseline')) AS v(c))"""


def _report_facts(rep: DataFrame, *more) -> DataFrame:
    inside = F.lit(True)
    for c in ("precision", "recall", "f1"):
        inside = inside & F.col(c).between(0.0, 1.0)
    p, r = F.col("precision"), F.col("recall")
    harmonic = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return rep.select(
        *more, "class", "support", inside.alias("bounded"),
        F.when(F.col("class").isin("0", "1"), F.abs(F.col("f1") - harmonic) < 2e-4).otherwise(True).alias("f1_follows"),
        (F.col("leakage_warning") == ((F.col("class") == "accuracy") & (F.col("f1") > md.LEAKAGE_ACCURACY)))
        .alias("warning_follows"))


@query("exact_train_forest", _TEST + _REPORT_SQL)
def q_train(spark, sf):
    _, pred, _ = md.train_forest(mq.matrix(spark, sf))
    return _report_facts(md.holdout_report(pred))


@query("exact_model_comparison", _TEST + "\nSELECT m.model, r.* FROM (" + _REPORT_SQL
       + ") r CROSS JOIN (VALUES ('filtered'), ('rf_selected')) AS m(model)")
def q_comparison(spark, sf):
    return _report_facts(mq.q_model_comparison(spark, sf), "model")


@query("exact_cross_validate", o.with_base("""
SELECT metric, split, count(churn) > 0 AS bounded, true AS warning_follows
FROM labeled_v CROSS JOIN (VALUES ('accuracy'), ('f1'), ('roc_auc')) AS m(metric)
CROSS JOIN (VALUES ('train'), ('validation')) AS s(split) GROUP BY ALL"""))
def q_cv(spark, sf):
    r = mq.q_cross_validate(spark, sf)
    return r.select("metric", "split", (F.col("mean").between(0.0, 1.0) & F.col("std").between(0.0, 0.5)).alias("bounded"),
                    (F.col("leakage_warning") == ((F.col("metric") == "accuracy") & (F.col("mean") > md.LEAKAGE_ACCURACY)))
                    .alias("warning_follows"))


_RULE = "repository_maintenance_ratio"
_CV_SQL = o.with_base("""
SELECT c.fold, c.split, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
       round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
       round((pos_ranks - (tp + fn) * (tp + fn + 1) / 2.0) / nullif((tp + fn) * CAST(tn + fp AS DOUBLE), 0), 6) AS roc_auc
FROM counts c""", _ORDERED + f""",
x AS (SELECT f.fold, CASE WHEN rk % 5 = f.fold THEN 'validation' ELSE 'train' END AS split, l.churn, l.{_RULE} AS s
      FROM o_rows r JOIN labeled_v l ON l.login = r.login CROSS JOIN range(5) f(fold)),
th AS (SELECT fold, round(avg(s), 6) AS mean FROM x WHERE split = 'train' GROUP BY fold),
sc AS (SELECT x.*, CASE WHEN s > mean THEN 1 ELSE 0 END AS pred,
              rank() OVER w + (count(*) OVER (PARTITION BY x.fold, split, s) - 1) / 2.0 AS r
       FROM x JOIN th ON th.fold = x.fold WINDOW w AS (PARTITION BY x.fold, split ORDER BY s)),
counts AS (SELECT CAST(fold AS INT) AS fold, split, count(*) FILTER (WHERE churn = 1 AND pred = 1) AS tp,
                  count(*) FILTER (WHERE churn = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE churn = 1 AND pred = 0) AS fn,
                  count(*) FILTER (WHERE churn = 0 AND pred = 0) AS tn, sum(r) FILTER (WHERE churn = 1) AS pos_ranks
           FROM sc GROUP BY ALL)""")


@query("fold_metrics", _CV_SQL)
def q_fold_metrics(spark, sf):
    """Confusion counts, accuracy, F1 and AUC of every fold and split, by the
    cross-validation itself with a one-column rule in place of the forest."""
    m = mq.matrix(spark, sf)
    scores = md.fold_scores(m, md.threshold_rule(_RULE), parallelism=2)
    return md.fold_metrics(scores).select(
        "fold", "split", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "roc_auc")])


@query("cross_validate_rule", _CV_SQL.replace("""
SELECT c.fold, c.split""", """,
m AS (SELECT c.fold, c.split""").replace("FROM counts c", """FROM counts c)
SELECT metric, split, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, metric = 'accuracy' AND avg(v) > 0.98 AS leakage_warning
FROM (SELECT split, 'accuracy' AS metric, accuracy AS v FROM m UNION ALL SELECT split, 'f1', f1 FROM m
      UNION ALL SELECT split, 'roc_auc', roc_auc FROM m) GROUP BY metric, split"""))
def q_cv_rule(spark, sf):
    """Cross-validation of the one-column rule: means and deviations."""
    cv = md.cross_validate(mq.matrix(spark, sf), [], fit=md.threshold_rule(_RULE), parallelism=2)
    return cv.select("metric", "split", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "leakage_warning")


def _score_facts(scored: DataFrame) -> DataFrame:
    p = F.col("churn_probability")
    return scored.select(
        "login", p.between(0.0, 1.0).alias("bounded"),
        (F.col("churn_percentage") == percent_text(p)).alias("percent_follows"),
        # the tier is taken from the unrounded probability: a rounded one on the cut proves nothing
        ((F.col("risk_tier") == risk_tier(p)) | p.isin(md_cuts())).alias("tier_follows"),
        (F.col("status") == F.when(F.col("churned"), "High Risk").otherwise("Low Risk")).alias("status_follows"))


def md_cuts():
    from retentio.operators.scoring import HIGH_RISK, MEDIUM_RISK
    return [HIGH_RISK, MEDIUM_RISK]


_SCORE_SQL = """
SELECT login, true AS bounded, true AS percent_follows, true AS tier_follows, true AS status_follows FROM {view}"""


def trained_model(spark, sf):
    return md.train_forest(mq.matrix(spark, sf))[0]


@query("exact_batch_score", o.with_base(_SCORE_SQL.format(view="defective_v"), DEFECTIVE_V))
def q_score(spark, sf):
    """Scoring input with NULL, NaN and infinite features."""
    return _score_facts(batch_score(trained_model(spark, sf), defective(spark, sf)))


@query("exact_model_roundtrip", o.with_base("SELECT login, true AS same_score FROM features_v"))
def q_roundtrip(spark, sf):
    """A saved and loaded model gives every user the score of the original."""
    model = trained_model(spark, sf)
    back = md.load_model(md.save_model(model, scratch_path(spark, "model")))
    f = features(spark, sf)
    a = batch_score(model, f).select("login", F.col("churn_probability").alias("a"))
    b = batch_score(back, f).select(F.col("login").alias("l2"), F.col("churn_probability").alias("b"))
    return a.join(b, F.col("login") == F.col("l2")).select("login", (F.col("a") == F.col("b")).alias("same_score"))


@query("exact_score_landed_users", o.with_base(_SCORE_SQL.format(view="features_v")))
def q_score_landed(spark, sf):
    return _score_facts(mq.q_score_landed_users(spark, sf))


MODEL_COLS = [c for c in TRAIN_COLS if c not in ("active_repo_ratio", "inactive_repo_ratio")]


def _features_sql(cols, columns):
    values = ", ".join(f"('{c}')" for c in cols)
    return o.with_base(f"""
SELECT feature, {columns} FROM (SELECT count(*) AS n FROM labeled_v) CROSS JOIN (VALUES {values}) AS v(feature)""")


def _importance_facts(imp: DataFrame, k: int) -> DataFrame:
    """One row per feature; every flag holds for the whole table."""
    t = imp.agg(F.sum("importance").alias("s"), F.min("importance").alias("lo"),
                F.sort_array(F.collect_list("rank")).alias("ranks"),
                F.array_sort(F.collect_list(F.struct("rank", "importance"))).alias("byrank")).first()
    falls = all(x["importance"] >= y["importance"] for x, y in zip(t["byrank"], t["byrank"][1:]))
    return imp.select("feature", F.lit(abs(t["s"] - 1) < 1e-6).alias("sums_to_one"), F.lit(t["lo"] >= 0).alias("positive"),
                      F.lit(list(t["ranks"]) == list(range(1, k + 1)) and falls).alias("ranked"))


_IMP = "true AS sums_to_one, true AS positive, n > 0 AS ranked"


@query("exact_model_importance", _features_sql(MODEL_COLS, _IMP))
def q_importance(spark, sf):
    return _importance_facts(mq.q_model_importance(spark, sf), len(MODEL_COLS))


@query("exact_dt_selection", _features_sql(TRAIN_COLS, _IMP))
def q_dt(spark, sf):
    return _importance_facts(mq.q_dt_selection(spark, sf), len(TRAIN_COLS))


@query("exact_rf_selection", _features_sql(TRAIN_COLS, _IMP))
def q_rf(spark, sf):
    return _importance_facts(mq.q_rf_selection(spark, sf), len(TRAIN_COLS))


_NO_AGE = [c for c in TRAIN_COLS if c != "account_age_days"]


@query("exact_dt_selection_regression", _features_sql(_NO_AGE, _IMP))
def q_dt_regression(spark, sf):
    return _importance_facts(mq.q_dt_selection_regression(spark, sf), len(_NO_AGE))


@query("exact_rf_selection_regression", _features_sql(_NO_AGE, _IMP))
def q_rf_regression(spark, sf):
    return _importance_facts(mq.q_rf_selection_regression(spark, sf), len(_NO_AGE))


def _rfe_facts(r: DataFrame, k: int) -> DataFrame:
    rows = r.collect()  # one row per feature
    want = [1] * k + list(range(2, len(rows) - k + 2))
    ordered = [x["ranking"] for x in rows] == want
    flags = all(x["selected"] == (x["ranking"] == 1) for x in rows)
    return r.select("feature", F.lit(ordered).alias("ordered_by_ranking"), F.lit(flags).alias("selected_rank_first"))


_RFE = "n > 0 AS ordered_by_ranking, true AS selected_rank_first"


@query("exact_rfe_selection", _features_sql(TRAIN_COLS, _RFE))
def q_rfe(spark, sf):
    return _rfe_facts(mq.q_rfe_selection(spark, sf), mq.TOP_K)


@query("exact_rfe_logistic", _features_sql(TRAIN_COLS, _RFE))
def q_rfe_logistic(spark, sf):
    return _rfe_facts(mq.q_rfe_logistic(spark, sf), mq.TOP_K)


_NO_RATE = [c for c in TRAIN_COLS if c != "repos_per_year"]


@query("exact_rfe_linear", _features_sql(_NO_RATE, _RFE))
def q_rfe_linear(spark, sf):
    return _rfe_facts(mq.q_rfe_linear(spark, sf), mq.TOP_K)


@query("exact_rfe_forest_regression", _features_sql(_NO_RATE, _RFE))
def q_rfe_forest_regression(spark, sf):
    """Elimination by a regression forest (numeric target), all rounds."""
    return _rfe_facts(mq.q_rfe_forest_regression(spark, sf), mq.TOP_K)


# --- membership and consensus over exact selectors -----------------------------

_SETS = f"""vr AS ({o.unpivot("training_v", TRAIN_COLS, {"v": "round(var_pop({c}), 6)"})}),
rk AS (SELECT *, row_number() OVER (ORDER BY v DESC, ordinal) AS r FROM vr),
sets AS (SELECT 'variance' AS method, feature FROM vr WHERE v > 0.01
         UNION ALL SELECT 'top4', feature FROM rk WHERE r <= 4
         UNION ALL SELECT 'top6', feature FROM rk WHERE r <= 6)"""
METHODS = ["variance", "top4", "top6"]


def exact_sets(spark, sf):
    """(method, feature) of three selectors whose choice is exact."""
    from retentio.operators.stats import variance
    t = training(spark, sf)
    v = variance(t, TRAIN_COLS).select("feature", F.round("variance", 6).alias("importance"), "ordinal")
    picks = [v.where("importance > 0.01"), sel.select_top_k(v, k=4), sel.select_top_k(v, k=6)]
    out = None
    for method, p in zip(METHODS, picks):
        p = p.select(F.lit(method).alias("method"), "feature")
        out = p if out is None else out.unionByName(p)
    return out


@query("exact_selection_membership", o.with_base("""
SELECT feature, CAST(max(method = 'variance') AS INT) AS variance, CAST(max(method = 'top4') AS INT) AS top4,
       CAST(max(method = 'top6') AS INT) AS top6 FROM sets GROUP BY feature""", _SETS))
def q_membership(spark, sf):
    return sel.selection_membership(exact_sets(spark, sf), METHODS)


@query("exact_selection_consensus", o.with_base("""
SELECT feature, count(DISTINCT method) AS n_methods FROM sets GROUP BY feature HAVING count(DISTINCT method) >= 3""", _SETS))
def q_consensus(spark, sf):
    return sel.selection_consensus(exact_sets(spark, sf), 3)


# --- guards ----------------------------------------------------------------------

@query("require_columns", o.with_base("""
SELECT feature, feature NOT IN ('followers', 'churn') AS present, count(*) > 0 AS named
FROM features_v CROSS JOIN (VALUES ('login'), ('followers'), ('account_age_days'), ('churn')) AS v(feature) GROUP BY ALL"""))
def q_require(spark, sf):
    """Which wanted columns a feature table has, and that the guard names the
    missing ones."""
    from retentio.operators.labels import require_columns
    f, wanted = features(spark, sf), ["login", "followers", "account_age_days", "churn"]
    try:
        require_columns(f, wanted)
        text = ""
    except ValueError as e:
        text = str(e)
    n = f.groupBy().count()
    names = F.explode(F.array(*[F.lit(c) for c in wanted])).alias("feature")
    has = F.col("feature").isin(f.columns)
    return n.select("count", names).select("feature", has.alias("present"),
                                           ((F.lit(text).contains(F.col("feature")) != has) & (F.col("count") > 0)).alias("named"))


@query("target_leakage", o.with_base("""
SELECT 'labeled' AS dataset, count(*) > 0 AS leaks FROM labeled_v
UNION ALL SELECT 'training', count(*) < 0 FROM training_v"""))
def q_leakage(spark, sf):
    """Whether the guard stops the table with and without the label's source."""
    from retentio.operators.labels import LeakageError, assert_no_leakage
    from retentio.plans.catalog import labeled

    def leaks(df):
        try:
            assert_no_leakage(df)
            return False
        except LeakageError:
            return True

    out = None
    for name, df in (("labeled", labeled(spark, sf)), ("training", training(spark, sf))):
        row = df.groupBy().count().select(F.lit(name).alias("dataset"), (F.lit(leaks(df)) & (F.col("count") > 0)).alias("leaks"))
        out = row if out is None else out.unionByName(row)
    return out


@query("days_between", """
SELECT o_orderkey, CAST(greatest(DATE '2001-08-01' - CAST(o_orderdate AS DATE), 0) AS INT) AS days FROM orders""")
def q_days_between(spark, sf):
    from retentio.functions.dates import as_of_date, days_between
    t = tables.table(spark, sf, "orders")
    return t.select("o_orderkey", days_between(F.to_date("o_orderdate"), as_of_date(tables.ORDERS_AS_OF)).alias("days"))


@query("classify_repos", o.with_base("""
SELECT login, CAST(total AS BIGINT) AS total, CAST(active AS BIGINT) AS active, CAST(total - active AS BIGINT) AS inactive,
       CAST(maintained AS BIGINT) AS maintained FROM f_agg"""))
def q_classify(spark, sf):
    from retentio.operators.features import repo_activity
    r = repo_activity(tables.repos(spark, sf, with_login=True), tables.ORDERS_AS_OF)
    return r.select("login", "total", "active", "inactive", "maintained")

"""Query catalog: every operator applied to the shared tables, with the
DuckDB statement that states the same result independently.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name] -> SQL``.
Queries without an oracle are model-based (MLlib) and checked by rows and
properties in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame  # noqa: F401
from pyspark.sql import functions as F

from retentio.operators import evaluation as ev
from retentio.operators import labels as lb
from retentio.operators import quality as qa
from retentio.operators import selection as sel
from retentio.operators import split as sp
from retentio.operators import stats as st
from retentio.plans import oracle as o
from retentio.plans.churn import table_features
from retentio.schemas import FEATURE_COLUMNS
from retentio.sources import tables

QUERIES: dict = {}
ORACLE: dict = {}

TRAIN_COLS = FEATURE_COLUMNS[1:]


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def features(spark, sf):
    return table_features(spark, sf)


# Defects that the quality operators exist for, placed by user number: the same
# expressions build the Spark frame and the SQL view.
DEFECTS = {
    "days_since_last_activity": "CASE WHEN k % 19 = 0 THEN -5 WHEN k % 19 = 1 THEN NULL ELSE days_since_last_activity END",
    "repos_per_year": "CASE WHEN k % 11 = 0 THEN {nan} WHEN k % 11 = 1 THEN {inf} WHEN k % 11 = 2 THEN NULL "
                      "WHEN k % 11 = 3 THEN -{inf} WHEN k % 11 = 4 THEN -repos_per_year - 1 ELSE repos_per_year END",
    "active_repo_ratio": "CASE WHEN k % 13 = 0 THEN 1.5 WHEN k % 13 = 1 THEN -0.5 WHEN k % 13 = 2 THEN {nan} "
                         "ELSE active_repo_ratio END",
    "avg_stars_per_repo": "CASE WHEN k % 17 = 0 THEN -3.0 WHEN k % 17 = 1 THEN {inf} WHEN k % 17 = 2 THEN NULL "
                          "ELSE avg_stars_per_repo END",
}
_KEY = "CAST(substr(login, -9) AS INT)"
_SQL_VALUES = {"nan": "CAST('NaN' AS DOUBLE)", "inf": "CAST('Infinity' AS DOUBLE)"}
DEFECTIVE_V = ("defective_v AS (SELECT login, " + ", ".join(
    (f"CAST({DEFECTS[c].format(**_SQL_VALUES)} AS {'INT' if c.startswith('days') else 'DOUBLE'})" if c in DEFECTS else c)
    + f" AS {c}" for c in FEATURE_COLUMNS) + f" FROM (SELECT *, {_KEY} AS k FROM features_v)),\n"
    "dlabeled_v AS (SELECT *, CAST(CASE WHEN days_since_last_activity >= 0 THEN "
    "CASE WHEN days_since_last_activity > 180 THEN 1 ELSE 0 END END AS TINYINT) AS churn FROM defective_v)")


def defective(spark, sf):
    """The feature table with NaN, ±inf, NULL, negative and out-of-range
    values in every few users' rows."""
    f = features(spark, sf).withColumn("k", F.substring("login", -9, 9).cast("int"))
    types = dict(f.dtypes)
    return f.select("login", *[
        (F.expr(DEFECTS[c].format(nan="double('NaN')", inf="double('Infinity')")).cast(types[c]) if c in DEFECTS
         else F.col(c)).alias(c) for c in FEATURE_COLUMNS])


def labeled(spark, sf):
    return lb.label_users(features(spark, sf))


def training(spark, sf):
    return lb.training_dataset(labeled(spark, sf))


# --- features and labels ---------------------------------------------------

@query("features", o.with_base("SELECT * FROM features_v"))
def q_features(spark, sf):
    return features(spark, sf)


@query("churn_label", o.with_base("SELECT * FROM labeled_v"))
def q_churn_label(spark, sf):
    return labeled(spark, sf)


@query("training_dataset", o.with_base("SELECT * FROM training_v"))
def q_training_dataset(spark, sf):
    return training(spark, sf)


@query("class_distribution", o.with_base("""
SELECT count(churn) AS total_users, count(*) FILTER (WHERE churn = 1) AS total_churned,
       count(*) FILTER (WHERE churn = 0) AS total_non_churned,
       CASE WHEN count(churn) > 0 THEN round(count(*) FILTER (WHERE churn = 1) / count(churn), 4) ELSE 0.0 END AS churn_rate,
       CASE WHEN count(churn) > 0 THEN round(count(*) FILTER (WHERE churn = 0) / count(churn), 4) ELSE 0.0 END AS non_churn_rate
FROM labeled_v"""))
def q_class_distribution(spark, sf):
    return lb.class_distribution(labeled(spark, sf))


@query("labeling_report", o.with_base("""
SELECT CAST(180 AS INT) AS threshold_days, count(*) AS total_records,
       count(*) FILTER (WHERE churn = 1) AS churned_users, count(*) FILTER (WHERE churn = 0) AS active_users,
       CASE WHEN count(churn) > 0 THEN round(count(*) FILTER (WHERE churn = 1) * 100.0 / count(churn), 2) ELSE 0.0 END AS churn_percentage,
       CASE WHEN count(churn) > 0 THEN round(count(*) FILTER (WHERE churn = 0) * 100.0 / count(churn), 2) ELSE 0.0 END AS active_percentage,
       true AS leakage_removed
FROM labeled_v"""))
def q_labeling_report(spark, sf):
    lab = labeled(spark, sf)
    return lb.labeling_report(lab, lb.training_dataset(lab))


_ALL_NUM = FEATURE_COLUMNS + ["churn"]


@query("quality_summary", o.with_base("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE))) AS n_inf, "
    f"count(*) FILTER (WHERE {c} IS NULL OR isnan(CAST({c} AS DOUBLE))) AS n_missing, "
    f"count(*) FILTER (WHERE {c} < 0) AS n_negative FROM dlabeled_v" for c in _ALL_NUM), DEFECTIVE_V))
def q_quality_summary(spark, sf):
    return qa.quality_summary(lb.label_users(defective(spark, sf))).withColumnRenamed("column", "feature")


@query("sanitise_features", o.with_base(
    "SELECT login, " + ", ".join(
        (f"CAST(greatest(least(coalesce(CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END, 0.0), 1.0), 0.0) AS DOUBLE) AS {c}"
         if c in qa.RATIO_COLUMNS else
         f"greatest(coalesce({c}, 0), 0) AS {c}" if c in ("days_since_last_activity", "account_age_days") else
         f"CAST(greatest(coalesce(CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END, 0.0), 0.0) AS DOUBLE) AS {c}"
         if c in qa.NON_NEGATIVE_COLUMNS else
         f"CAST(coalesce(CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END, 0.0) AS DOUBLE) AS {c}")
        for c in FEATURE_COLUMNS) + " FROM defective_v", DEFECTIVE_V))
def q_sanitise_features(spark, sf):
    return qa.sanitise_features(defective(spark, sf))


@query("validate_features", o.with_base(
    "SELECT login, days_since_last_activity, account_age_days, " + ", ".join(
        f"CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in FEATURE_COLUMNS[2:])
    + " FROM defective_v", DEFECTIVE_V))
def q_validate_features(spark, sf):
    return qa.validate_features(defective(spark, sf))


@query("numeric_only", o.with_base("SELECT * EXCLUDE (login) FROM labeled_v"))
def q_numeric_only(spark, sf):
    return qa.numeric_only(labeled(spark, sf))


@query("model_matrix", o.with_base(
    "SELECT login, account_age_days, repos_per_year, followers_following_ratio, avg_stars_per_repo, "
    "avg_forks_per_repo, repo_activity_density, repository_maintenance_ratio, CAST(churn AS INT) AS churn "
    "FROM dlabeled_v WHERE churn IS NOT NULL", DEFECTIVE_V))
def q_model_matrix(spark, sf):
    from retentio.operators.model import model_matrix
    return model_matrix(lb.label_users(defective(spark, sf)))


@query("prediction_features", o.with_base(
    "SELECT account_age_days, repos_per_year, followers_following_ratio, avg_stars_per_repo, "
    "avg_forks_per_repo, repo_activity_density, repository_maintenance_ratio FROM features_v"))
def q_prediction_features(spark, sf):
    from retentio.operators.scoring import prediction_features
    return prediction_features(features(spark, sf))


@query("align_features", o.with_base(
    "SELECT login, " + ", ".join(
        f"CAST(0.0 AS DOUBLE) AS {c}" if c in ("active_repo_ratio", "inactive_repo_ratio") else
        f"CASE WHEN {c} IS NULL OR isinf({c}) OR isnan({c}) THEN 0.0 ELSE CAST({c} AS DOUBLE) END AS {c}"
        for c in qa.RANGE_RULES) + " FROM defective_v", DEFECTIVE_V))
def q_align_features(spark, sf):
    from retentio.operators.scoring import align_features
    # scoring input keeps the key; the leaky columns are gone, so the two
    # payload ratios they feed are filled with 0.0
    f = defective(spark, sf)
    pf = f.drop("active_repo_ratio", "inactive_repo_ratio", "days_since_last_activity")
    return align_features(pf, list(qa.RANGE_RULES), keep=("login",))


def _range_sql():
    parts = []
    for c, (lo, hi) in qa.RANGE_RULES.items():
        cond = f"{c} IS NULL OR isnan({c})"
        if lo is not None:
            cond += f" OR {c} < {lo}"
        if hi is not None:
            cond += f" OR {c} > {hi}"
        parts.append(f"CASE WHEN {cond} THEN '{c}' END")
    joined = f"concat_ws(',', {', '.join(parts)})"
    return o.with_base(f"""
SELECT *, violations IS NULL AS valid FROM (
  SELECT *, CASE WHEN {joined} = '' THEN NULL ELSE {joined} END AS violations FROM defective_v)""", DEFECTIVE_V)


@query("range_check", _range_sql())
def q_range_check(spark, sf):
    return qa.range_check(defective(spark, sf))


# --- statistics --------------------------------------------------------------

def _describe_sql(view, cols):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
        f"round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {view}"
        for c in cols)


@query("describe_features", o.with_base(_describe_sql("features_v", FEATURE_COLUMNS)))
def q_describe_features(spark, sf):
    return st.describe(features(spark, sf), FEATURE_COLUMNS)


@query("describe_raw", o.with_base(_describe_sql("u_users", ["followers", "following", "public_repos"])))
def q_describe_raw(spark, sf):
    return st.describe(tables.users(spark, sf), ["followers", "following", "public_repos"])


@query("feature_variance", o.with_base(
    o.unpivot("training_v", TRAIN_COLS, {"variance": "round(var_pop({c}), 6)"})))
def q_feature_variance(spark, sf):
    return st.variance(training(spark, sf), TRAIN_COLS).withColumn("variance", F.round("variance", 6))


@query("correlation_matrix", o.with_base(o.pairs("training_v", TRAIN_COLS)))
def q_correlation_matrix(spark, sf):
    return st.correlation_pairs(training(spark, sf), TRAIN_COLS).withColumn("corr", F.round("corr", 6))


# Months before the reference day whose spend per customer makes a wide table.
MONTHS = 80


def monthly_spend(spark, sf):
    """Spend of every customer with orders in each of the last 80 months, one
    column per month (m0 = the reference month), NULL without an order."""
    orders = tables.table(spark, sf, "orders")
    ref = F.lit(tables.ORDERS_AS_OF)
    back = (F.year(ref) - F.year("o_orderdate")) * 12 + F.month(ref) - F.month("o_orderdate")
    wide = orders.withColumn("back", back).where(F.col("back").between(0, MONTHS - 1))
    return wide.groupBy("o_custkey").agg(*[
        F.sum(F.when(F.col("back") == k, F.col("o_totalprice"))).alias(f"m{k}") for k in range(MONTHS)])


@query("correlation_wide", f"""
WITH s AS (SELECT o_custkey, CAST((2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) AS INT) AS k, sum(o_totalprice) AS v
           FROM orders GROUP BY ALL),
j AS (SELECT a.k AS ka, b.k AS kb, a.v AS x, b.v AS y FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.k < b.k
      WHERE a.k >= 0 AND b.k < {MONTHS}),
r AS (SELECT ka, kb, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN round(corr(x, y), 5) END AS corr FROM j GROUP BY ALL)
SELECT 'm' || i AS feature_a, 'm' || k AS feature_b, CAST(i AS INT) AS ordinal_a, CAST(k AS INT) AS ordinal_b, corr
FROM range({MONTHS}) p(i) JOIN range({MONTHS}) q(k) ON i < k LEFT JOIN r ON ka = i AND kb = k""")
def q_correlation_wide(spark, sf):
    """Correlations of all pairs of 80 months of spend, by strips."""
    w = monthly_spend(spark, sf)
    return st.correlation_pairs(w, [f"m{k}" for k in range(MONTHS)]).withColumn("corr", F.round("corr", 5))


@query("ratio_histogram", o.with_base("""
SELECT CAST(least(CASE WHEN active_repo_ratio < 0 THEN 0 WHEN active_repo_ratio >= 1 THEN 21
                       ELSE CAST(floor(20 * active_repo_ratio) AS BIGINT) + 1 END, 20) AS BIGINT) AS bin,
       churn, count(*) AS n
FROM labeled_v WHERE active_repo_ratio IS NOT NULL GROUP BY ALL"""))
def q_ratio_histogram(spark, sf):
    return st.ratio_histogram(labeled(spark, sf)).withColumn("bin", F.col("bin").cast("long"))


@query("target_distribution", o.with_base("SELECT churn, count(*) AS n FROM labeled_v GROUP BY churn"))
def q_target_distribution(spark, sf):
    return st.target_distribution(labeled(spark, sf))


@query("majority_baseline", o.with_base("""
SELECT (SELECT churn FROM d ORDER BY n DESC, churn LIMIT 1) AS majority_class, max(n) AS majority_count,
       CAST(sum(n) AS BIGINT) AS labelled, round(max(n) / sum(n), 4) AS majority_accuracy FROM d""",
    "d AS (SELECT churn, count(*) AS n FROM labeled_v WHERE churn IS NOT NULL GROUP BY churn)"))
def q_majority_baseline(spark, sf):
    return st.majority_baseline(labeled(spark, sf))


# --- selection (exact) -------------------------------------------------------

def _raw_pairs(view, cols):
    return o.pairs(view, cols).replace("round(", "(").replace(", 6) AS corr", ") AS corr")


def _corr_report_sql(view, cols, threshold=0.9):
    feats = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, {i} AS ordinal" for i, c in enumerate(cols))
    return o.with_base(f"""
SELECT f.feature, f.ordinal, round(w.m, 6) AS max_abs_corr, coalesce(w.m > {threshold}, false) AS dropped
FROM f LEFT JOIN w ON w.feature = f.feature""", f"""p AS ({_raw_pairs(view, cols)}),
w AS (SELECT feature_b AS feature, max(abs(corr)) AS m FROM p GROUP BY feature_b),
f AS ({feats})""")


@query("variance_filter", o.with_base(
    "SELECT feature, ordinal, round(v, 6) AS variance, coalesce(v > 0.01, false) AS selected FROM ("
    + o.unpivot("training_v", TRAIN_COLS, {"v": "var_pop({c})"}) + ")"))
def q_variance_filter(spark, sf):
    return sel.variance_report(training(spark, sf), TRAIN_COLS).withColumn(
        "variance", F.round("variance", 6))


@query("correlation_filter", _corr_report_sql("training_v", TRAIN_COLS))
def q_correlation_filter(spark, sf):
    return sel.correlation_report(training(spark, sf), TRAIN_COLS).withColumn(
        "max_abs_corr", F.round("max_abs_corr", 6))


def _filter_selection_sql():
    var = o.unpivot("training_v", TRAIN_COLS, {"v": "var_pop({c})"})
    return o.with_base(f"""
SELECT feature, ordinal, round(v, 6) AS variance, coalesce(v > 0.01, false) AS passes_variance,
       round(m, 6) AS max_abs_corr, coalesce(v > 0.01, false) AND NOT coalesce(m > 0.9, false) AS selected
FROM vr LEFT JOIN (SELECT feature_b AS feature, max(abs(corr)) AS m FROM pr
  WHERE feature_a IN (SELECT feature FROM vr WHERE v > 0.01) AND feature_b IN (SELECT feature FROM vr WHERE v > 0.01)
  GROUP BY feature_b) USING (feature)""",
        f"vr AS ({var}),\npr AS (__PAIRS__)")


@query("filter_selection")
def q_filter_selection(spark, sf):
    return sel.filter_selection_report(training(spark, sf))


def _var_importance(spark, sf):
    """Population variance as an exact importance, at the reported precision
    (6 places): values equal there are ties and keep column order, whatever
    the floating summation order of the aggregate was."""
    v = st.variance(training(spark, sf), TRAIN_COLS)
    return v.select("feature", F.round("variance", 6).alias("importance"), "ordinal")


_RANK_SQL = ("SELECT feature, importance, ordinal, "
             "row_number() OVER (ORDER BY importance DESC, ordinal) AS rank FROM ("
             + o.unpivot("training_v", TRAIN_COLS, {"importance": "round(var_pop({c}), 6)"}) + ")")


@query("rank_importance", o.with_base(_RANK_SQL))
def q_rank_importance(spark, sf):
    return sel.rank_importance(_var_importance(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("select_top_k", o.with_base(f"SELECT * FROM ({_RANK_SQL}) WHERE rank <= 6"))
def q_select_top_k(spark, sf):
    return sel.select_top_k(_var_importance(spark, sf), k=6).withColumn("rank", F.col("rank").cast("long"))


@query("select_min_importance", o.with_base(
    "SELECT feature, importance, ordinal, rank FROM ("
    "SELECT *, row_number() OVER (ORDER BY importance DESC, ordinal) AS rank FROM ("
    + o.unpivot("training_v", TRAIN_COLS, {"importance": "round(var_pop({c}), 6)"}) + ")) WHERE importance >= 0.01"))
def q_select_min_importance(spark, sf):
    return sel.select_top_k(_var_importance(spark, sf), min_importance=0.01).withColumn(
        "rank", F.col("rank").cast("long"))


# --- split, folds, weights ---------------------------------------------------

_SPLIT_SQL = o.with_base("""
SELECT churn, false AS is_test, n_tr AS n FROM tr
UNION ALL SELECT churn, true AS is_test, n - n_tr AS n FROM tr""", """
cnt AS (SELECT churn, count(*) AS n FROM labeled_v WHERE churn IS NOT NULL GROUP BY churn),
tot AS (SELECT sum(n) AS total, sum(n) - CAST(ceil(0.2 * sum(n)) AS BIGINT) AS n_train FROM cnt),
fl AS (SELECT c.churn, c.n, floor(c.n * t.n_train / CAST(t.total AS DOUBLE)) AS base,
              c.n * t.n_train / CAST(t.total AS DOUBLE) - floor(c.n * t.n_train / CAST(t.total AS DOUBLE)) AS rem,
              t.n_train FROM cnt c JOIN tot t ON true),
rk AS (SELECT *, row_number() OVER (ORDER BY rem DESC, churn) AS rr,
              max(n_train) OVER () - sum(base) OVER () AS need FROM fl),
tr AS (SELECT churn, n, CAST(base + CASE WHEN rr <= need THEN 1 ELSE 0 END AS BIGINT) AS n_tr FROM rk)""")


_ORDERED = """o_rows AS (SELECT login, churn, row_number() OVER (
    PARTITION BY churn ORDER BY md5(login || '|42'), login) - 1 AS rk FROM labeled_v WHERE churn IS NOT NULL)"""
_SPLIT_ROWS = _SPLIT_SQL.replace("""
SELECT churn, false AS is_test, n_tr AS n FROM tr
UNION ALL SELECT churn, true AS is_test, n - n_tr AS n FROM tr""", f""",
{_ORDERED}
SELECT login, o_rows.churn, rk < n - n_tr AS is_test FROM o_rows JOIN tr ON tr.churn = o_rows.churn""")


@query("stratified_split", _SPLIT_ROWS)
def q_stratified_split(spark, sf):
    return sp.stratified_split(labeled(spark, sf)).select("login", "churn", "is_test")


@query("stratified_folds", o.with_base("SELECT login, churn, CAST(rk % 5 AS INT) AS fold FROM o_rows", _ORDERED))
def q_stratified_folds(spark, sf):
    return sp.stratified_folds(labeled(spark, sf)).select("login", "churn", "fold")


@query("class_weights", o.with_base("""
SELECT churn, n, round((SELECT sum(n) FROM cnt) / ((SELECT count(*) FROM cnt) * CAST(n AS DOUBLE)), 6) AS weight
FROM cnt""", "cnt AS (SELECT churn, count(*) AS n FROM labeled_v WHERE churn IS NOT NULL GROUP BY churn)"))
def q_class_weights(spark, sf):
    return sp.class_weights(labeled(spark, sf)).withColumn("weight", F.round("weight", 6))


# --- evaluation --------------------------------------------------------------

def rule_predictions(spark, sf):
    """Baseline rule: no active repository → churned."""
    return labeled(spark, sf).withColumn(
        "prediction", (F.col("active_repo_ratio") == 0).cast("int"))


_CONF_SQL = ("SELECT CAST(churn AS INT) AS label, CASE WHEN active_repo_ratio = 0 THEN 1 ELSE 0 END AS prediction, "
             "count(*) AS n FROM labeled_v GROUP BY ALL")


@query("confusion_matrix", o.with_base(_CONF_SQL))
def q_confusion_matrix(spark, sf):
    return ev.confusion_matrix(rule_predictions(spark, sf), "churn", "prediction")


def _report_sql():
    per = []
    for c in (0, 1):
        per.append(f"""SELECT '{c}' AS class, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f, sup
FROM (SELECT CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS r, sup
      FROM (SELECT sum(n) FILTER (WHERE label = {c} AND prediction = {c}) * 1.0 AS tp,
                   coalesce(sum(n) FILTER (WHERE prediction = {c}), 0) * 1.0 AS pp,
                   CAST(coalesce(sum(n) FILTER (WHERE label = {c}), 0) AS BIGINT) AS sup FROM cm))""")
    return o.with_base("""
SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, sup AS support FROM per
UNION ALL SELECT 'accuracy', round(a, 4), round(a, 4), round(a, 4), t FROM
  (SELECT (SELECT coalesce(sum(n), 0) FROM cm WHERE label = prediction) * 1.0 / sum(n) AS a, CAST(sum(n) AS BIGINT) AS t FROM cm)
UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), (SELECT CAST(sum(n) AS BIGINT) FROM cm) FROM per
UNION ALL SELECT 'weighted avg', round(sum(p * sup) / sum(sup), 4), round(sum(r * sup) / sum(sup), 4),
                 round(sum(f * sup) / sum(sup), 4), CAST(sum(sup) AS BIGINT) FROM per""",
                       f"cm AS ({_CONF_SQL}),\nper AS ({' UNION ALL '.join(per)})")


@query("classification_report", _report_sql())
def q_classification_report(spark, sf):
    return ev.classification_report(ev.confusion_matrix(rule_predictions(spark, sf), "churn", "prediction"))


def _auc_sql():
    parts = []
    for c in FEATURE_COLUMNS:
        parts.append(f"""SELECT '{c}' AS feature, (sum(ar) FILTER (WHERE churn = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc
FROM (SELECT churn, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS ar,
             count(*) FILTER (WHERE churn = 1) OVER () AS n1, count(*) FILTER (WHERE churn = 0) OVER () AS n0
      FROM labeled_v WHERE {c} IS NOT NULL AND churn IS NOT NULL) GROUP BY n1, n0""")
    return o.with_base("SELECT feature, round(auc, 6) AS roc_auc, greatest(round(auc, 6), 1 - round(auc, 6)) > 0.98 AS leak_suspect FROM ("
                       + "\nUNION ALL\n".join(parts) + ")")


@query("roc_auc", _auc_sql())
def q_roc_auc(spark, sf):
    return ev.feature_auc(labeled(spark, sf), FEATURE_COLUMNS)


# --- scoring format ----------------------------------------------------------

@query("score_format", o.with_base("""
SELECT login, round(inactive_repo_ratio, 4) AS churn_probability, inactive_repo_ratio > 0.5 AS churned,
       CAST(CAST(round(CAST(round(inactive_repo_ratio, 4) AS DECIMAL(10,4)) * 100, 1) AS DECIMAL(6,1)) AS VARCHAR) || '%' AS churn_percentage,
       CASE WHEN round(inactive_repo_ratio, 4) > 0.6 THEN 'high' WHEN round(inactive_repo_ratio, 4) > 0.3 THEN 'medium' ELSE 'low' END AS risk_tier,
       CASE WHEN inactive_repo_ratio > 0.5 THEN 'High Risk' ELSE 'Low Risk' END AS status
FROM features_v"""))
def q_score_format(spark, sf):
    from retentio.operators.scoring import score_columns
    f = features(spark, sf)
    return f.select("login", *score_columns(F.col("inactive_repo_ratio")))


@query("retention_action", o.with_base("""
SELECT login, CASE WHEN p > 0.6 THEN CASE WHEN coalesce(avg_stars_per_repo > 100.0, false) THEN 'high-touch' ELSE 'moderate' END
                   WHEN p > 0.3 THEN 'moderate' WHEN p > 0.0 THEN 'low-cost' ELSE 'none' END AS action
FROM (SELECT login, inactive_repo_ratio AS p, avg_stars_per_repo FROM features_v)"""))
def q_retention_action(spark, sf):
    from retentio.operators.scoring import retention_action
    f = features(spark, sf)
    return f.select("login", retention_action(F.col("inactive_repo_ratio"),
                                              F.col("avg_stars_per_repo"), 100.0).alias("action"))


ORACLE["filter_selection"] = _filter_selection_sql().replace("__PAIRS__", _raw_pairs("training_v", TRAIN_COLS))


def _register_more():
    # imported for their @query side effects
    from retentio.plans import behavior_queries, flow_queries, ingest_queries, model_checks, model_queries  # noqa: F401


_register_more()

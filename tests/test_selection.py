from pyspark.sql import functions as F

from retentio.operators import selection as sel

# Published importance tables (literal golden inputs).
RF_GOLDEN = [("followers_following_ratio", 0.1999), ("account_age_days", 0.1592),
             ("repos_per_year", 0.1386), ("avg_stars_per_repo", 0.1119), ("avg_forks_per_repo", 0.1041),
             ("active_repo_ratio", 0.0868), ("repo_activity_density", 0.0832),
             ("repository_maintenance_ratio", 0.0594), ("inactive_repo_ratio", 0.0568)]
DT_GOLDEN = [("days_since_last_activity", 1.0)] + [(f, 0.0) for f in [
    "account_age_days", "repos_per_year", "followers_following_ratio", "active_repo_ratio",
    "inactive_repo_ratio", "avg_stars_per_repo", "avg_forks_per_repo", "repo_activity_density",
    "repository_maintenance_ratio"]]
SETS = {
    "filter": ["account_age_days", "repos_per_year", "followers_following_ratio", "active_repo_ratio",
               "inactive_repo_ratio", "avg_stars_per_repo", "avg_forks_per_repo",
               "repository_maintenance_ratio"],
    "dt": ["days_since_last_activity", "account_age_days", "repos_per_year", "followers_following_ratio",
           "active_repo_ratio", "inactive_repo_ratio"],
    "rf": ["followers_following_ratio", "account_age_days", "repos_per_year", "avg_stars_per_repo",
           "avg_forks_per_repo", "active_repo_ratio"],
    "rfe": ["repos_per_year", "followers_following_ratio", "active_repo_ratio", "inactive_repo_ratio",
            "repo_activity_density", "days_since_last_activity"],
}


def imp(spark, rows):
    return sel.importance_table(spark, [r[0] for r in rows], [r[1] for r in rows])


def test_top_k_matches_published_sets(spark):
    rf = [r.feature for r in sel.select_top_k(imp(spark, RF_GOLDEN), k=6).orderBy("rank").collect()]
    assert rf == SETS["rf"]
    dt = [r.feature for r in sel.select_top_k(imp(spark, DT_GOLDEN), k=6).orderBy("rank").collect()]
    assert dt == SETS["dt"]


def test_min_importance_and_missing_arguments(spark):
    got = {r.feature for r in sel.select_top_k(imp(spark, RF_GOLDEN), min_importance=0.1).collect()}
    assert got == {"followers_following_ratio", "account_age_days", "repos_per_year",
                   "avg_stars_per_repo", "avg_forks_per_repo"}
    import pytest
    with pytest.raises(ValueError):
        sel.select_top_k(imp(spark, RF_GOLDEN))


def test_consensus_and_membership(spark):
    long = spark.createDataFrame([(m, f) for m, fs in SETS.items() for f in fs], "method string, feature string")
    cons = {r.feature: r.n_methods for r in sel.selection_consensus(long, 3).collect()}
    assert cons == {"followers_following_ratio": 4, "repos_per_year": 4, "active_repo_ratio": 4,
                    "account_age_days": 3, "inactive_repo_ratio": 3}
    mem = {r.feature: (r.filter, r.dt, r.rf, r.rfe)
           for r in sel.selection_membership(long, list(SETS)).collect()}
    assert mem["repo_activity_density"] == (0, 0, 0, 1)
    assert mem["followers_following_ratio"] == (1, 1, 1, 1)


def test_correlation_filter_is_not_greedy(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=400), rng.normal(size=400)
    a = u
    c = 0.8 * u + 0.6 * v          # r(a, c) ≈ 0.8
    b = (a + c) / 2                # r(a, b), r(b, c) ≈ 0.95
    rows = [(float(x), float(y), float(z), 1.0) for x, y, z in zip(a, b, c)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    from retentio.operators.stats import correlation_pairs
    pairs = {(r.feature_a, r.feature_b): r.corr for r in correlation_pairs(df, ["a", "b", "c", "k"]).collect()}
    assert abs(pairs[("a", "b")]) > 0.9 and abs(pairs[("b", "c")]) > 0.9 and abs(pairs[("a", "c")]) < 0.9
    assert pairs[("a", "k")] is None      # constant column: no r, never dropped here
    # b is dropped by a; c is dropped by b although b itself is dropped
    assert sel.correlation_filter(df, ["a", "b", "c", "k"]) == ["a", "k"]


def test_variance_filter_is_population_and_strict(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.25, 1.0)], "x double, y double")
    # population variance of x = 0.015625 exactly (sample variance would be 0.03125)
    import pytest
    with pytest.raises(sel.SelectionError):
        sel.variance_filter(df, ["x", "y"], 0.015625)
    assert sel.variance_filter(df, ["x", "y"], 0.0156) == ["x"]


def test_fixture_variance_filter_drops_the_two_ratios(spark):
    from retentio.plans.catalog import training
    t = training(spark, "/root/testdata/sf0.01")
    kept = sel.variance_filter(t, sel.candidate_features(t))
    assert "active_repo_ratio" not in kept and "inactive_repo_ratio" not in kept
    assert "repository_maintenance_ratio" in kept


def test_describe_approximate_quartiles_are_close(spark):
    from retentio.operators.stats import describe
    df = spark.range(0, 1001).select(F.col("id").cast("double").alias("x"))
    ex = describe(df, ["x"]).first()
    ap = describe(df, ["x"], exact=False).first()
    assert (ex.p25, ex.p50, ex.p75) == (250.0, 500.0, 750.0)
    assert abs(ap.p50 - 500.0) <= 1.0 and ap["count"] == ex["count"] == 1001

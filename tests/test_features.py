import datetime as dt
import json

from pyspark.sql import functions as F

from retentio.operators.features import features_from_records
from retentio.operators.quality import sanitise_features
from retentio.schemas import RAW_USER

AS_OF = dt.date(2024, 6, 30)


def ago(days):
    return (AS_OF - dt.timedelta(days=days)).isoformat() + "T00:00:00Z"


def record(login, repos, **kw):
    rec = {"login": login, "followers": kw.get("followers", 10), "following": kw.get("following", 4),
           "public_repos": kw.get("public_repos", 3), "created_at": kw.get("created_at", ago(730)),
           "updated_at": kw.get("updated_at", ago(10)), "repositories": repos}
    for k in ("created_at", "updated_at"):
        if kw.get(k, "") is None:
            rec.pop(k)
    return rec


def load(spark, tmp_path, recs):
    p = tmp_path / "users.json"
    p.write_text("\n".join(json.dumps(r) for r in recs))
    return spark.read.schema(RAW_USER).json(str(p))


def feats(spark, tmp_path, recs):
    out = features_from_records(load(spark, tmp_path, recs), AS_OF)
    return {r.login: r for r in out.collect()}


def test_malformed_elements_are_skipped_but_counted(spark, tmp_path):
    recs = [record("mal", [{"stargazers_count": 3, "pushed_at": ago(5)}, 5, None])]
    r = feats(spark, tmp_path, recs)["mal"]
    assert r.active_repo_ratio == round(1 / 3, 4)
    assert r.inactive_repo_ratio == 0.0
    assert r.avg_stars_per_repo == 1.0


def test_not_a_list_missing_or_empty_means_no_repositories(spark, tmp_path):
    recs = [record("oops", "oops"), record("empty", []), {"login": "none", "followers": 1}]
    got = feats(spark, tmp_path, recs)
    for k in ("oops", "empty", "none"):
        r = got[k]
        assert (r.active_repo_ratio, r.avg_stars_per_repo, r.repository_maintenance_ratio) == (0.0, 0.0, 0.0)


def test_missing_dates_and_age_defaults(spark, tmp_path):
    recs = [record("nodates", [], created_at=None, updated_at=None),
            record("today", [], created_at=AS_OF.isoformat())]
    got = feats(spark, tmp_path, recs)
    assert got["nodates"].days_since_last_activity == 0
    assert got["nodates"].account_age_days == 1
    assert got["today"].account_age_days == 1


def test_activity_and_maintenance_edges(spark, tmp_path):
    repos = [{"pushed_at": ago(180), "updated_at": ago(90)},
             {"pushed_at": ago(181), "updated_at": ago(91)},
             {"pushed_at": ago(-3)}, {"pushed_at": "not a date"}]
    r = feats(spark, tmp_path, [record("edge", repos)])["edge"]
    assert r.active_repo_ratio == 0.5          # 180 days and the future push
    assert r.inactive_repo_ratio == 0.5        # 181 days and the unparsable push
    assert r.repository_maintenance_ratio == 0.25


def test_bad_numbers_drop_the_user(spark, tmp_path):
    recs = [record("badf", [], followers="abc"), record("badr", [{"stargazers_count": "x"}]),
            record("good", [{"stargazers_count": "12.5"}]), {"followers": 3}, record("", [])]
    got = feats(spark, tmp_path, recs)
    assert set(got) == {"good"}
    assert got["good"].avg_stars_per_repo == 12.5


def test_rounding_is_half_up(spark, tmp_path):
    repos = [{"pushed_at": ago(1)}] + [{"pushed_at": ago(400)}] * 31
    r = feats(spark, tmp_path, [record("tie", repos)])["tie"]
    assert r.active_repo_ratio == 0.0313


def test_sanitise_clamps_after_nan_repair(spark):
    df = spark.createDataFrame(
        [("a", -3, 5, 1.0, -2.0, float("nan"), 1.5, float("inf"), 1.0, -1.0, -0.5)],
        "login string, days_since_last_activity int, account_age_days int, repos_per_year double, "
        "followers_following_ratio double, active_repo_ratio double, inactive_repo_ratio double, "
        "avg_stars_per_repo double, avg_forks_per_repo double, repo_activity_density double, "
        "repository_maintenance_ratio double")
    r = sanitise_features(df).first()
    assert r.days_since_last_activity == 0
    assert r.followers_following_ratio == -2.0      # not clamped
    assert r.active_repo_ratio == 0.0               # NaN → 0
    assert r.inactive_repo_ratio == 1.0             # clamped
    assert r.avg_stars_per_repo == 0.0              # inf → 0
    assert r.repo_activity_density == 0.0
    assert r.repository_maintenance_ratio == 0.0


def test_repartitioning_does_not_change_features(spark):
    from retentio.plans.churn import table_features
    a = table_features(spark, "/root/testdata/sf0.001")
    b = table_features(spark, "/root/testdata/sf0.001").repartition(3, F.col("login"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_nested_route_reads_each_text_once_and_keeps_odd_elements(spark):
    good = {"repo_id": 1, "pushed_at": ago(1), "updated_at": ago(1), "stargazers_count": "2", "forks_count": 1}
    elements = [good, {**good, "repo_id": "x", "size": {"a": [1]}}, {**good, "watchers_count": 1.5}, None, 5]
    texts = [json.dumps(e) for e in elements] + [json.dumps(good)[:-1], "{", "[1]"]
    df = spark.createDataFrame([("u", "1", "0", "8", ago(730), ago(10), texts)],
                               "login string, followers string, following string, public_repos string, "
                               "created_at string, updated_at string, repositories array<string>")
    out = features_from_records(df, AS_OF)
    # three elements carry values, five more count in the total only
    r = out.first()
    assert (r.active_repo_ratio, r.avg_stars_per_repo, r.repository_maintenance_ratio) == (0.375, 0.75, 0.375)
    # a formatter per repository and layout: two dates of the repository, two of the profile
    plan = out.select("active_repo_ratio", "repository_maintenance_ratio")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("yyyy-M-d'T'H:m:sXXX") <= 4, plan

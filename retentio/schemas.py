"""Declared schemas. Nothing downstream of a reader relies on inference."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

# Repository element as it lands in raw JSON. Counters stay text so that a
# malformed number can be told apart from a missing one.
REPO = T.StructType([
    T.StructField("repo_name", S), T.StructField("repo_id", L),
    T.StructField("created_at", S), T.StructField("updated_at", S),
    T.StructField("pushed_at", S),
    T.StructField("stargazers_count", S), T.StructField("forks_count", S),
    T.StructField("watchers_count", L), T.StructField("language", S),
    T.StructField("size", L), T.StructField("open_issues_count", L),
    T.StructField("default_branch", S),
])

PROFILE_FIELDS = ["login", "id", "followers", "following", "public_repos", "public_gists",
                  "created_at", "updated_at", "company", "location", "bio"]
METRIC_FIELDS = ["total_repositories", "total_stars_received", "total_forks_received",
                 "active_repositories", "inactive_repositories"]

# Raw user record. ``repositories`` is read as ARRAY<STRING>: each element is
# parsed on its own, so one malformed element does not null the whole array.
RAW_USER = T.StructType([
    T.StructField("login", S), T.StructField("id", L),
    T.StructField("followers", S), T.StructField("following", S),
    T.StructField("public_repos", S), T.StructField("public_gists", S),
    T.StructField("created_at", S), T.StructField("updated_at", S),
    T.StructField("company", S), T.StructField("location", S), T.StructField("bio", S),
    T.StructField("total_repositories", L), T.StructField("total_stars_received", L),
    T.StructField("total_forks_received", L), T.StructField("active_repositories", L),
    T.StructField("inactive_repositories", L),
    T.StructField("repositories", T.ArrayType(S)),
    T.StructField("scraped_at", S),
    # record part (users heavier than the per-record bound span several parts)
    T.StructField("part", L),
])

FEATURE_COLUMNS = [
    "days_since_last_activity", "account_age_days", "repos_per_year",
    "followers_following_ratio", "active_repo_ratio", "inactive_repo_ratio",
    "avg_stars_per_repo", "avg_forks_per_repo", "repo_activity_density",
    "repository_maintenance_ratio",
]

FEATURES = T.StructType(
    [T.StructField("login", S), T.StructField("days_since_last_activity", I),
     T.StructField("account_age_days", I)]
    + [T.StructField(c, D) for c in FEATURE_COLUMNS[2:]])

LABELED = T.StructType(FEATURES.fields + [T.StructField("churn", T.ByteType())])

TARGET = "churn"
LEAK_COLUMN = "days_since_last_activity"
# Columns derived from the same inactivity window as the label.
LEAKY_COLUMNS = ["days_since_last_activity", "active_repo_ratio", "inactive_repo_ratio"]
ID_COLUMNS = ["login"]

SEARCH_PAGE = T.StructType([
    T.StructField("query", S), T.StructField("page", I),
    T.StructField("total_count", L),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("login", S)]))),
])

IMPORTANCE = T.StructType([T.StructField("feature", S), T.StructField("importance", D)])
RANKING = T.StructType([T.StructField("feature", S), T.StructField("ranking", I)])

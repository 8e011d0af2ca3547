"""DuckDB statements that state each registered query independently, as
flat SQL over the same parquet tables. Used as the correctness oracle."""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"
EV_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def days(x: str) -> str:
    return f"({AS_OF} - CAST({x} AS DATE))"


U_REPOS = """u_repos AS (
  SELECT c.c_name AS login, c.c_custkey AS owner_id, o.o_orderkey AS repo_id,
         o.o_orderpriority AS language, o.o_orderdate AS created_at, o.o_orderdate AS pushed_at,
         l.updated_at, l.stargazers_count, l.forks_count
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS updated_at,
                    CAST(sum(l_quantity) AS BIGINT) AS stargazers_count, count(*) AS forks_count
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""

U_USERS = """u_users AS (
  SELECT c.c_name AS login, c.c_custkey AS id,
         CAST(floor(abs(c.c_acctbal)) AS INT) AS followers, c.c_nationkey AS following,
         coalesce(r.n, 0) AS public_repos, r.created_at, r.updated_at
  FROM customer c LEFT JOIN (SELECT login, count(*) AS n, min(created_at) AS created_at,
         max(pushed_at) AS updated_at FROM u_repos GROUP BY login) r ON r.login = c.c_name)"""

FEATURES_V = f"""f_agg AS (
  SELECT login, count(*) AS total,
     sum(CASE WHEN greatest({days('pushed_at')},0) <= 180 THEN 1 ELSE 0 END) AS active,
     sum(CASE WHEN updated_at IS NOT NULL AND greatest({days('updated_at')},0) <= 90 THEN 1 ELSE 0 END) AS maintained,
     sum(coalesce(stargazers_count,0)) AS stars, sum(coalesce(forks_count,0)) AS forks
  FROM u_repos GROUP BY login),
f_u AS (
  SELECT u.login, followers, following, public_repos,
     CASE WHEN u.updated_at IS NULL THEN 0 ELSE greatest({days('u.updated_at')},0) END AS inact,
     CASE WHEN u.created_at IS NULL THEN 1 ELSE greatest({days('u.created_at')},1) END AS age,
     coalesce(a.total,0) AS total, coalesce(a.active,0) AS active, coalesce(a.maintained,0) AS maintained,
     coalesce(a.stars,0) AS stars, coalesce(a.forks,0) AS forks
  FROM u_users u LEFT JOIN f_agg a ON a.login = u.login),
features_v AS (
  SELECT login, CAST(inact AS INT) AS days_since_last_activity, CAST(age AS INT) AS account_age_days,
    round(public_repos/(age/CAST(365.25 AS DOUBLE)),4) AS repos_per_year,
    round(CAST(followers AS DOUBLE)/(following+1),4) AS followers_following_ratio,
    CASE WHEN total=0 THEN 0.0 ELSE round(CAST(active AS DOUBLE)/total,4) END AS active_repo_ratio,
    CASE WHEN total=0 THEN 0.0 ELSE round(CAST(total-active AS DOUBLE)/total,4) END AS inactive_repo_ratio,
    CASE WHEN total=0 THEN 0.0 ELSE round(CAST(stars AS DOUBLE)/total,4) END AS avg_stars_per_repo,
    CASE WHEN total=0 THEN 0.0 ELSE round(CAST(forks AS DOUBLE)/total,4) END AS avg_forks_per_repo,
    round(active/(age/CAST(365.25 AS DOUBLE)),4) AS repo_activity_density,
    CASE WHEN total=0 THEN 0.0 ELSE round(CAST(maintained AS DOUBLE)/total,4) END AS repository_maintenance_ratio
  FROM f_u),
labeled_v AS (
  SELECT *, CAST(CASE WHEN days_since_last_activity > 180 THEN 1 ELSE 0 END AS TINYINT) AS churn
  FROM features_v),
training_v AS (SELECT * EXCLUDE (days_since_last_activity) FROM labeled_v)"""

BASE = f"WITH {U_REPOS},\n{U_USERS},\n{FEATURES_V}"

FEATURE_COLS = ["days_since_last_activity", "account_age_days", "repos_per_year",
                "followers_following_ratio", "active_repo_ratio", "inactive_repo_ratio",
                "avg_stars_per_repo", "avg_forks_per_repo", "repo_activity_density",
                "repository_maintenance_ratio"]
TRAIN_COLS = FEATURE_COLS[1:]


def with_base(body: str, extra: str = "") -> str:
    return f"{BASE}{',' + extra if extra else ''}\n{body}"


def unpivot(view: str, cols: list[str], exprs: dict[str, str]) -> str:
    """UNION ALL of one row per column with aggregate expressions ({c})."""
    parts = []
    for i, c in enumerate(cols):
        sel = ", ".join(f"{e.format(c=c)} AS {k}" for k, e in exprs.items())
        parts.append(f"SELECT '{c}' AS feature, {i} AS ordinal, {sel} FROM {view}")
    return "\nUNION ALL\n".join(parts)


def pairs(view: str, cols: list[str]) -> str:
    parts = []
    for a in range(len(cols)):
        for b in range(a + 1, len(cols)):
            x, y = cols[a], cols[b]
            parts.append(
                f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, {a} AS ordinal_a, {b} AS ordinal_b, "
                f"round(CASE WHEN stddev_pop({x}) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) * "
                f"stddev_pop({y}) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) = 0 THEN NULL ELSE "
                f"covar_pop({x}, {y}) / (stddev_pop({x}) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) * "
                f"stddev_pop({y}) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)) END, 6) AS corr FROM {view}")
    return "\nUNION ALL\n".join(parts)

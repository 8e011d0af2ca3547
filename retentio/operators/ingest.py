"""Ingest operators for user / repository records.

* projections of API-shaped records (profile fields, repository fields);
* ``assemble_users``: profile + nested repositories + activity metrics in
  record parts of at most ``max_repos`` repositories: every user has part 0,
  and part k holds the repositories ranked k·max_repos and up, so no user is
  ever collected whole into a row;
* ``upsert_users``: keyed merge (case-insensitive login), latest batch and
  latest position win, position = first appearance;
* validity filters of the feature layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.dates import to_timestamp_any
from retentio.functions.numbers import bad_number, number_or_zero
from retentio.operators.ordering import range_bucketed, running_sums
from retentio.schemas import PROFILE_FIELDS
from retentio.session import write_once

# Repository fields kept from an API repository object, in order,
# as (source field, output name).
REPO_FIELDS = [("name", "repo_name"), ("id", "repo_id"), ("created_at", "created_at"),
               ("updated_at", "updated_at"), ("pushed_at", "pushed_at"),
               ("stargazers_count", "stargazers_count"), ("forks_count", "forks_count"),
               ("watchers_count", "watchers_count"), ("language", "language"),
               ("size", "size"), ("open_issues_count", "open_issues_count"),
               ("default_branch", "default_branch")]

MAX_REPOS_PER_RECORD = 10_000
# Repositories of one user that one task ranks.
MAX_SORTED = 100_000
ACTIVITY_DAYS = 180


def project_user(raw: DataFrame) -> DataFrame:
    """The eleven profile fields (missing ones as NULL)."""
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c)
                        for c in PROFILE_FIELDS])


def project_repo(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Twelve repository fields, ``name``/``id`` renamed (``keep`` columns,
    such as the owner key of a flat table, pass through first)."""
    return raw.select(*[F.col(k) for k in keep],
                      *[(F.col(s) if s in raw.columns else F.lit(None)).alias(o)
                        for s, o in REPO_FIELDS])


def activity_metrics(repos: DataFrame, as_of, key: str = "login",
                     days: int = ACTIVITY_DAYS) -> DataFrame:
    """Collector-side counts per key: total repositories, Σ stars, Σ forks,
    active (whole days since push <= 180, future pushes included) and
    inactive (older, missing or unparsable push). Counters that do not cast
    add 0 here; ``reject_bad_numbers`` drops their users."""
    ref = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    pushed = to_timestamp_any(F.col("pushed_at"), repos.schema["pushed_at"].dataType)
    whole_days = F.floor((F.unix_seconds(ref) - F.unix_seconds(pushed)) / 86400)
    active = pushed.isNotNull() & (whole_days <= days)
    return repos.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_repositories"),
        F.sum(number_or_zero(F.col("stargazers_count"), repos.schema["stargazers_count"].dataType)
              ).alias("total_stars_received"),
        F.sum(number_or_zero(F.col("forks_count"), repos.schema["forks_count"].dataType)
              ).alias("total_forks_received"),
        F.count_if(active).alias("active_repositories"),
        F.count_if(~active).alias("inactive_repositories"))


def assemble_users(users: DataFrame, repos: DataFrame, as_of=None, key: str = "login",
                   repo_key: str = "repo_id", max_repos: int = MAX_REPOS_PER_RECORD,
                   max_sorted: int = MAX_SORTED) -> DataFrame:
    """Raw user records: profile + metrics + ``repositories`` array + part.

    One layout for every user: part = ⌊rank / max_repos⌋ of the user's
    repositories in id order. Part 0 always exists, with an empty array for
    users without repositories; all parts carry the profile and the user's
    total metrics. Users absent from ``users`` get none.

    The repositories move once, to their user: rank, arrays and the join with
    the profile share that partitioning. Users with more than ``max_sorted``
    repositories are ranked over quantile ranges instead, so a heavy user's
    rows are ordered in many tasks.
    """
    # written once: the metrics, the heavy users and the rows all read it
    repos = write_once(repos.where(F.col(key).isNotNull()), "repos")
    metrics = write_once(activity_metrics(repos, as_of, key), "metrics")
    cols = [repo_key] + [c for c in repos.columns if c not in (key, repo_key)]

    def parts(rows: DataFrame, rank) -> DataFrame:
        part = F.floor(rank / max_repos).cast("long").alias("part")
        return (rows.select(key, part, F.struct(*[F.col(c) for c in cols]).alias("_r"))
                .groupBy(key, "part").agg(F.sort_array(F.collect_list("_r")).alias("repositories")))

    def light(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(key).orderBy(repo_key)
        return parts(rows.withColumn("_rank", F.row_number().over(order) - 1), F.col("_rank"))

    heavy = metrics.where(F.col("total_repositories") > max_sorted).select(key)
    if heavy.isEmpty():
        nested = light(repos)
    else:
        # each has more than max_sorted rows, so they are few
        heavy = F.broadcast(heavy)
        ranged = range_bucketed(repos.join(heavy, key, "left_semi"), [key, repo_key])
        ranked = running_sums(ranged, [key], "_vb", [F.col(repo_key)], {"_one": F.lit(1)})
        nested = light(repos.join(heavy, key, "left_anti")).unionByName(parts(ranked, F.col("_one_before")))
    elem = nested.schema["repositories"].dataType
    records = (users.join(metrics, key, "left")
               .join(nested, key, "left")
               .withColumn("part", F.coalesce(F.col("part"), F.lit(0).cast("long")))
               .withColumn("repositories", F.coalesce(F.col("repositories"), F.array().cast(elem))))
    for c in ("total_repositories", "total_stars_received", "total_forks_received",
              "active_repositories", "inactive_repositories"):
        records = records.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("long")))
    return records


def first_parts(records: DataFrame) -> DataFrame:
    """One row per user: part 0 of every record."""
    return records.where(F.col("part") == 0) if "part" in records.columns else records


def valid_users(raw: DataFrame) -> DataFrame:
    """Rows with a non-empty login."""
    return raw.where(F.coalesce(F.col("login"), F.lit("")) != "")


def reject_bad_numbers(raw: DataFrame, column: str = "repositories") -> DataFrame:
    """Drop users with a present but uncastable followers / following /
    public_repos, or a repository whose stars / forks do not cast."""
    sch = raw.schema
    bad = F.lit(False)
    for c in ("followers", "following", "public_repos"):
        if c in raw.columns:
            bad = bad | bad_number(F.col(c), sch[c].dataType)
    if column in raw.columns and isinstance(sch[column].dataType, T.ArrayType) \
            and isinstance(sch[column].dataType.elementType, T.StructType):
        st = sch[column].dataType.elementType
        def bad_repo(f, ft):
            return lambda r: r.isNotNull() & bad_number(r[f], ft, "double")

        for f in ("stargazers_count", "forks_count"):
            if f in st.fieldNames():
                bad = bad | F.coalesce(F.exists(F.col(column), bad_repo(f, st[f].dataType)),
                                       F.lit(False))
    if "part" not in raw.columns:
        return raw.where(~bad)
    # one bad part drops all parts of the user (blank logins differ by id)
    keys = [c for c in ("login", "id") if c in raw.columns]
    gone = raw.where(bad).select(*[F.col(c).alias(f"_bad_{c}") for c in keys]).distinct()
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_bad_{c}"))
    return raw.where(~bad).join(gone, same, "left_anti")


def upsert_users(existing: DataFrame, incoming: DataFrame, key: str = "login") -> DataFrame:
    """Keyed merge by lower(login): incoming beats existing, a later row of
    the same batch beats an earlier one; empty logins are dropped. All parts
    of the winning record are kept. ``first_batch``/``first_pos`` give the
    position of the key's first appearance (the output order).

    Both inputs need a ``pos`` column (row position inside its batch)."""
    both = (existing.withColumn("_batch", F.lit(0))
            .unionByName(incoming.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
            .where(F.coalesce(F.col(key), F.lit("")) != "")
            .withColumn("_k", F.lower(F.col(key))))
    # only (key, batch, pos) is reduced; the records meet the winners by join
    order = F.struct(F.col("_batch").alias("b"), F.col("pos").alias("p"))
    best = both.groupBy("_k").agg(F.max(order).alias("_win"), F.min(order).alias("_first")).select(
        F.col("_k").alias("_wk"), F.col("_win.b").alias("_wb"), F.col("_win.p").alias("_wp"),
        F.col("_first.b").alias("first_batch"), F.col("_first.p").alias("first_pos"))
    won = both.join(best, (F.col("_k") == F.col("_wk")) & (F.col("_batch") == F.col("_wb"))
                    & (F.col("pos") == F.col("_wp")))
    return won.drop("_k", "_batch", "_wk", "_wb", "_wp")


def flatten_users(raw: DataFrame) -> DataFrame:
    """One flat row per user: part 0 without its repositories."""
    return first_parts(raw).drop("repositories")

"""Account features from user profiles and their repositories.

Two routes produce the same per-user repository statistics:

* ``repo_activity`` — flat repositories, one row each, ``groupBy(key)`` with
  map-side partial aggregation (a user owning a third of all repositories is
  pre-aggregated in every map task, so no task sees the whole group);
* ``nested_repo_activity`` — records that carry their repositories as an array
  (landed JSON, or ``assemble_users`` output, at most a bounded number of
  repositories per record). Counting uses higher-order array functions inside
  the row, record parts of one user are then summed.

``account_features`` turns profile columns plus those statistics into the ten
feature columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.dates import as_of_date, days_between, to_utc_date
from retentio.functions.numbers import bad_number, div_or_zero, number_or_zero, size_or_zero

# Activity windows and the year length used by the feature layer.
ACTIVE_DAYS = 180
MAINTAINED_DAYS = 90
DAYS_PER_YEAR = 365.25

STAT_COLUMNS = ["total", "active", "inactive", "maintained", "stars", "forks", "has_bad_number"]
STAT_FIELDS = ("pushed_at", "updated_at", "stargazers_count", "forks_count")


def _field_type(struct: T.StructType, name: str) -> T.DataType:
    return struct[name].dataType if name in struct.fieldNames() else T.NullType()


def _field(r: Column, struct: T.StructType, name: str) -> Column:
    return r[name] if name in struct.fieldNames() else F.lit(None)


def _repo_values(r: Column, struct: T.StructType) -> dict[str, Column]:
    """Per-repository dates and amounts, read from their text."""
    st_t = _field_type(struct, "stargazers_count")
    fk_t = _field_type(struct, "forks_count")
    st = _field(r, struct, "stargazers_count")
    fk = _field(r, struct, "forks_count")
    return {
        "pushed": to_utc_date(_field(r, struct, "pushed_at"), _field_type(struct, "pushed_at")),
        "updated": to_utc_date(_field(r, struct, "updated_at"), _field_type(struct, "updated_at")),
        "stars": number_or_zero(st, st_t, "double"),
        "forks": number_or_zero(fk, fk_t, "double"),
        "bad": bad_number(st, st_t, "double") | bad_number(fk, fk_t, "double"),
    }


def _within(day: Column, as_of: Column, days: int) -> Column:
    return day.isNotNull() & (days_between(day, as_of) <= days)


def repo_activity(repos: DataFrame, as_of=None, key: str = "login",
                  active_days: int = ACTIVE_DAYS,
                  maintained_days: int = MAINTAINED_DAYS, extra=()) -> DataFrame:
    """Flat route: per-key total / active / inactive / maintained counts and
    star / fork sums in one aggregation pass (plus ``extra`` aggregates).

    A row whose optional ``malformed`` column is true counts in ``total`` only.
    """
    ref = as_of_date(as_of)
    t = _repo_values(F.struct(*[F.col(c) for c in repos.columns]), repos.schema)
    active = _within(t["pushed"], ref, active_days)
    ok = ~F.col("malformed") if "malformed" in repos.columns else F.lit(True)
    return repos.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok & active).alias("active"),
        F.count_if(ok & ~active).alias("inactive"),
        F.count_if(ok & _within(t["updated"], ref, maintained_days)).alias("maintained"),
        F.sum(F.when(ok, t["stars"]).otherwise(0.0)).alias("stars"),
        F.sum(F.when(ok, t["forks"]).otherwise(0.0)).alias("forks"),
        F.max(ok & t["bad"]).alias("has_bad_number"),
        *extra,
    )


def parse_repositories(records: DataFrame, column: str = "repositories",
                       schema: T.StructType | None = None) -> DataFrame:
    """ARRAY<STRING> of JSON elements → ARRAY<STRUCT>. Elements that are not a
    JSON object (``5``, ``null``, text) become NULL but stay in the array, so
    they still count in the repository total; a non-array value is NULL."""
    from retentio.schemas import REPO
    schema = schema or REPO
    parsed = F.transform(
        F.col(column),
        lambda e: F.when(F.ltrim(e).startswith("{"), F.from_json(e, schema)))
    return records.withColumn(column, parsed)


def nested_repo_activity(records: DataFrame, as_of=None, column: str = "repositories",
                         active_days: int = ACTIVE_DAYS,
                         maintained_days: int = MAINTAINED_DAYS) -> DataFrame:
    """Adds the ``STAT_COLUMNS`` computed inside each record's array.

    ``column`` must be ARRAY<STRUCT> (use ``parse_repositories`` first for
    landed JSON). NULL elements are malformed: skipped, but counted in
    ``total``. A NULL array counts as empty. Each element's text is read once
    (``transform``: an expression inside a lambda runs as often as it is
    named) and folded in one ``aggregate`` pass.
    """
    ref = as_of_date(as_of)
    arr_t = records.schema[column].dataType
    struct = arr_t.elementType
    arr = F.coalesce(F.col(column), F.array().cast(arr_t))

    def value_struct(r):
        t = _repo_values(r, struct)
        return F.struct(r.isNotNull().alias("ok"), *[v.alias(k) for k, v in t.items()])

    zero = F.struct(F.lit(0).cast("long").alias("valid"), F.lit(0).cast("long").alias("active"),
                    F.lit(0).cast("long").alias("maintained"), F.lit(0.0).alias("stars"),
                    F.lit(0.0).alias("forks"), F.lit(False).alias("bad"))

    def counted(c):
        return F.when(c, 1).otherwise(0).cast("long")

    def merge(acc, t):
        return F.struct((acc["valid"] + counted(t["ok"])).alias("valid"),
                        (acc["active"] + counted(t["ok"] & _within(t["pushed"], ref, active_days))).alias("active"),
                        (acc["maintained"] + counted(t["ok"] & _within(t["updated"], ref, maintained_days))).alias("maintained"),
                        (acc["stars"] + F.when(t["ok"], t["stars"]).otherwise(0.0)).alias("stars"),
                        (acc["forks"] + F.when(t["ok"], t["forks"]).otherwise(0.0)).alias("forks"),
                        (acc["bad"] | F.coalesce(t["ok"] & t["bad"], F.lit(False))).alias("bad"))

    folded = F.aggregate(F.transform(arr, value_struct), zero, merge)
    out = records.withColumn("_agg", folded).withColumn("total", size_or_zero(arr).cast("long"))
    return out.select(
        *[c for c in records.columns], "total",
        F.col("_agg.active").alias("active"),
        (F.col("_agg.valid") - F.col("_agg.active")).alias("inactive"),
        F.col("_agg.maintained").alias("maintained"),
        F.col("_agg.stars").alias("stars"), F.col("_agg.forks").alias("forks"),
        F.col("_agg.bad").alias("has_bad_number"))


def account_features(users: DataFrame, repo_stats: DataFrame | None = None, as_of=None,
                     user_key: str = "login", stats_key: str | None = None,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Ten account features per user (login + 10 columns, FEATURES schema).

    ``users`` holds the profile (login, followers, following, public_repos,
    created_at, updated_at; text or typed). ``repo_stats`` holds
    ``STAT_COLUMNS`` per key; when ``None`` they are expected on ``users``
    (nested route). Users without a login, or with a number that does not
    cast anywhere in their record, are dropped.
    """
    ref = as_of_date(as_of)
    if repo_stats is not None:
        stats_key = stats_key or user_key
        stats = repo_stats.select(F.col(stats_key).alias("__k"), *STAT_COLUMNS)
        users = users.join(stats, users[user_key] == stats["__k"], "left").drop("__k")
    sch = users.schema

    def typed(name):
        return F.col(name), sch[name].dataType

    upd = to_utc_date(*typed("updated_at"))
    crt = to_utc_date(*typed("created_at"))
    inact = F.coalesce(days_between(upd, ref), F.lit(0))
    age = F.greatest(F.coalesce(days_between(crt, ref), F.lit(1)), F.lit(1))
    followers = number_or_zero(*typed("followers"))
    following = number_or_zero(*typed("following"))
    public_repos = number_or_zero(*typed("public_repos"))
    bad = (bad_number(*typed("followers")) | bad_number(*typed("following"))
           | bad_number(*typed("public_repos")) | F.coalesce(F.col("has_bad_number"), F.lit(False)))

    total = F.coalesce(F.col("total"), F.lit(0))
    active = F.coalesce(F.col("active"), F.lit(0))
    years = F.col("account_age_days").cast("double") / F.lit(DAYS_PER_YEAR)

    base = (users
            .where(F.coalesce(F.col("login"), F.lit("")) != "")
            .where(~bad)
            .select(F.col("login"), *[F.col(k) for k in keep],
                    inact.cast("int").alias("days_since_last_activity"),
                    age.cast("int").alias("account_age_days"),
                    public_repos.alias("_public_repos"),
                    followers.alias("_followers"), following.alias("_following"),
                    total.alias("_total"), active.alias("_active"),
                    F.coalesce(F.col("inactive"), F.lit(0)).alias("_inactive"),
                    F.coalesce(F.col("maintained"), F.lit(0)).alias("_maintained"),
                    F.coalesce(F.col("stars"), F.lit(0.0)).alias("_stars"),
                    F.coalesce(F.col("forks"), F.lit(0.0)).alias("_forks")))
    t = F.col("_total")
    return base.select(
        "login", *keep, "days_since_last_activity", "account_age_days",
        F.when(years < 1.0 / DAYS_PER_YEAR, 0.0)
         .otherwise(F.round(F.col("_public_repos") / years, 4)).alias("repos_per_year"),
        F.round(F.col("_followers").cast("double") / (F.col("_following") + 1), 4)
         .alias("followers_following_ratio"),
        div_or_zero(F.col("_active"), t).alias("active_repo_ratio"),
        div_or_zero(F.col("_inactive"), t).alias("inactive_repo_ratio"),
        div_or_zero(F.col("_stars"), t).alias("avg_stars_per_repo"),
        div_or_zero(F.col("_forks"), t).alias("avg_forks_per_repo"),
        F.when(years < 1.0 / DAYS_PER_YEAR, 0.0)
         .otherwise(F.round(F.col("_active") / years, 4)).alias("repo_activity_density"),
        div_or_zero(F.col("_maintained"), t).alias("repository_maintenance_ratio"),
    )


def features_from_records(records: DataFrame, as_of=None, column: str = "repositories") -> DataFrame:
    """Nested route end to end. ``records`` may hold several parts per login
    (``part`` column, see ``assemble_users``): their statistics are summed."""
    arr_t = records.schema[column].dataType
    if isinstance(arr_t, T.ArrayType) and isinstance(arr_t.elementType, T.StringType):
        from retentio.schemas import REPO
        # only the fields that the statistics read
        records = parse_repositories(records, column, T.StructType([f for f in REPO.fields if f.name in STAT_FIELDS]))
    with_stats = nested_repo_activity(records, as_of, column).drop(column)
    if "part" in with_stats.columns:
        # every part repeats the record's profile, so the profile columns are
        # grouping keys and the combine stays a hash aggregation of sums
        profile = [c for c in ("followers", "following", "public_repos", "created_at", "updated_at")
                   if c in with_stats.columns]
        with_stats = with_stats.groupBy("login", *profile).agg(
            *[F.sum(c).alias(c) for c in STAT_COLUMNS if c != "has_bad_number"],
            F.max("has_bad_number").alias("has_bad_number"))
    return account_features(with_stats, None, as_of)

"""Landed raw records: API-shaped user / repository objects derived from the
shared tables, JSON-lines landing, and the raw readers.

The collector itself (HTTP, paging, rate limits) is not rebuilt: records
arrive as files. Everything here is a Spark job whose size follows the
tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.schemas import RAW_USER, SEARCH_PAGE
from retentio.session import prepare_session
from retentio.sources import tables

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso(c) -> F.Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, ISO)


def api_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile objects as the collector receives them (dates as ISO text)."""
    u = tables.users(spark, sf_dir)
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = tables.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation has one row per nation: a fixed-size dimension
    return (u.join(c, u.id == c.c_custkey)
            .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select("login", "id", "followers", "following", "public_repos",
                    F.lit(None).cast("long").alias("public_gists"),
                    iso("created_at").alias("created_at"), iso("updated_at").alias("updated_at"),
                    F.col("c_mktsegment").alias("company"), F.col("n_name").alias("location"),
                    F.lit(None).cast("string").alias("bio"), F.lit("User").alias("type")))


def api_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository objects as the collector receives them, with the owner's
    login and a few fields the projection drops."""
    r = tables.repos(spark, sf_dir, with_login=True)
    return r.select(
        "login", F.concat(F.lit("repo-"), F.col("repo_id").cast("string")).alias("name"),
        F.col("repo_id").alias("id"), iso("created_at").alias("created_at"),
        iso("updated_at").alias("updated_at"), iso("pushed_at").alias("pushed_at"),
        "stargazers_count", "forks_count", F.col("forks_count").alias("watchers_count"),
        "language", F.col("stargazers_count").alias("size"),
        F.lit(0).cast("long").alias("open_issues_count"), F.lit("main").alias("default_branch"),
        F.lit(False).alias("private"), F.col("owner_id").alias("owner_id"))


def landed_users(spark: SparkSession, sf_dir: str, as_of=tables.ORDERS_AS_OF,
                 max_repos: int | None = None) -> DataFrame:
    """Assembled raw user records (profile + metrics + repositories + scraped_at)."""
    from retentio.operators.ingest import MAX_REPOS_PER_RECORD, assemble_users, project_repo, project_user
    users = project_user(api_users(spark, sf_dir))
    ar = api_repos(spark, sf_dir)
    repos = project_repo(ar, keep=("login",))
    rec = assemble_users(users, repos, as_of, max_repos=max_repos or MAX_REPOS_PER_RECORD)
    return rec.withColumn("scraped_at", F.lit(f"{as_of.isoformat()}T00:00:00+00:00"))


def write_json_lines(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_raw_users(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw user records with the declared schema; ``repositories`` stays an
    array of JSON texts (see schemas.RAW_USER). ``multi_line`` reads one
    JSON array per file."""
    prepare_session(spark)
    return (spark.read.schema(RAW_USER).option("multiLine", multi_line)
            .option("mode", "PERMISSIVE").json(path))


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed search result pages: one JSON object per line with the query,
    the page number the collector requested, total_count and items."""
    prepare_session(spark)
    return spark.read.schema(SEARCH_PAGE).json(path)

"""Adapter views: the driver's star-schema tables read as retention inputs.

"User" = customer, "repository" = order, push = order date, update = last
ship date of the order's lines, stars = Σ quantity, forks = number of lines.
Every view is a lazy plan over the parquet scans, so filters and column
pruning reach the files.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.session import prepare_session

# Reference days of the adapter views.
ORDERS_AS_OF = _dt.date(2001, 8, 1)
EVENTS_AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of a shared table."""
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: last ship date, Σ quantity, line count (partial agg by key)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("updated_at"),
        F.sum("l_quantity").cast("long").alias("stargazers_count"),
        F.count(F.lit(1)).alias("forks_count"))


def repos(spark: SparkSession, sf_dir: str, with_login: bool = False) -> DataFrame:
    """One row per repository: owner_id, repo_id, language, created_at,
    pushed_at, updated_at, stargazers_count, forks_count (+ login)."""
    o = table(spark, sf_dir, "orders")
    lines = order_lines(spark, sf_dir)
    r = (o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
         .select(F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("repo_id"),
                 F.col("o_orderpriority").alias("language"),
                 F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("pushed_at"),
                 "updated_at", "stargazers_count", "forks_count"))
    if with_login:
        c = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("login"))
        r = r.join(c, "owner_id")
    return r


def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per owner: repository count, first creation, last push."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("owner_id")).agg(
        F.count(F.lit(1)).alias("public_repos"),
        F.min("o_orderdate").alias("created_at"),
        F.max("o_orderdate").alias("updated_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User profiles: login, id, followers, following, public_repos,
    created_at, updated_at (users without repositories keep NULL dates)."""
    c = table(spark, sf_dir, "customer")
    p = profile_counts(spark, sf_dir)
    return (c.join(p, c.c_custkey == p.owner_id, "left")
            .select(F.col("c_name").alias("login"), F.col("c_custkey").alias("id"),
                    F.floor(F.abs("c_acctbal")).cast("int").alias("followers"),
                    F.col("c_nationkey").alias("following"),
                    F.coalesce(F.col("public_repos"), F.lit(0)).alias("public_repos"),
                    "created_at", "updated_at"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")

"""Flagship plans: account features and churn labels from the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.operators.features import STAT_COLUMNS, account_features, repo_activity
from retentio.sources import tables


def table_features(spark: SparkSession, sf_dir: str, as_of=tables.ORDERS_AS_OF) -> DataFrame:
    """Features for every customer.

    One aggregation per owner id yields both the repository statistics and
    the profile fields the adapter derives from repositories (count, first
    creation, last push), before anything meets the customer table, so that
    join is 1:1 and the orders are read once.
    """
    stats = repo_activity(tables.repos(spark, sf_dir), as_of, key="owner_id",
                          extra=(F.min("created_at").alias("created_at"),
                                 F.max("pushed_at").alias("updated_at")))
    c = tables.table(spark, sf_dir, "customer")
    users = (c.join(stats, c.c_custkey == stats.owner_id, "left")
             .select(F.col("c_name").alias("login"),
                     F.floor(F.abs("c_acctbal")).cast("int").alias("followers"),
                     F.col("c_nationkey").alias("following"),
                     F.coalesce(F.col("total"), F.lit(0)).alias("public_repos"),
                     "created_at", "updated_at", *STAT_COLUMNS))
    return account_features(users, None, as_of)

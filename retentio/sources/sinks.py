"""Writers for feature, labelled, training and selected tables, and the
feature-table reader (CSV first, then Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.operators.labels import assert_no_leakage
from retentio.schemas import FEATURES, LABELED
from retentio.session import path_exists, prepare_session


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def save_features(df: DataFrame, path: str, fmt: str = "csv") -> str:
    return write_csv(df, path) if fmt == "csv" else write_parquet(df, path)


def save_labeled(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Dataset A; the Parquet form stores ``churn`` as FLOAT."""
    if fmt == "parquet":
        return write_parquet(df.withColumn("churn", F.col("churn").cast("float")), path)
    return write_csv(df, path)


def save_training(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Dataset B; the leakage guard runs before anything is written."""
    assert_no_leakage(df)
    if fmt == "parquet":
        return write_parquet(df.withColumn("churn", F.col("churn").cast("float")), path)
    return write_csv(df, path)


def save_selected(df: DataFrame, features: list[str], target: str, path: str) -> str:
    return write_csv(df.select(*features, target), path)


def save_ranking(ranking: DataFrame, path: str) -> str:
    # one row per feature: a single output file is the natural form
    return write_csv(ranking.coalesce(1), path)


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    prepare_session(spark)
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_feature_table(spark: SparkSession, csv_path: str | None, parquet_path: str | None,
                       schema=FEATURES) -> DataFrame:
    """CSV when it exists, else Parquet, else an error."""
    prepare_session(spark)
    if csv_path and path_exists(spark, csv_path):
        return read_csv(spark, csv_path, schema)
    if parquet_path and path_exists(spark, parquet_path):
        return spark.read.parquet(parquet_path)
    raise FileNotFoundError(f"no feature table at {csv_path} or {parquet_path}")


def read_training_csv(spark: SparkSession, path: str, target: str = "churn",
                      schema=LABELED) -> DataFrame:
    df = read_csv(spark, path, schema)
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    return df

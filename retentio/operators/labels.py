"""Churn labels, the leakage-free training set and label reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.schemas import FEATURE_COLUMNS, LEAK_COLUMN, TARGET

# Fixed value: inactivity days above which a user is churned.
CHURN_THRESHOLD_DAYS = 180


class LeakageError(ValueError):
    """The label's source column is present in a training table."""


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Raise listing every missing column (schema check, no job)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def churn_label(value: Column, dtype: T.DataType | None = None,
                threshold: float = CHURN_THRESHOLD_DAYS) -> Column:
    """1 if value > threshold, 0 if 0 <= value <= threshold; NULL for NULL,
    NaN, ±inf, negative or non-numeric input. TINYINT."""
    v = value.try_cast("double") if isinstance(dtype, T.StringType) else value.cast("double")
    valid = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))) & (v >= 0)
    return F.when(valid, F.when(v > F.lit(float(threshold)), 1).otherwise(0)).cast("tinyint")


def label_users(features: DataFrame, threshold: float = CHURN_THRESHOLD_DAYS,
                source: str = LEAK_COLUMN) -> DataFrame:
    """Dataset A: the feature table plus ``churn``."""
    require_columns(features, [source])
    return features.withColumn(
        TARGET, churn_label(F.col(source), features.schema[source].dataType, threshold))


def training_dataset(labeled: DataFrame, leak_column: str = LEAK_COLUMN) -> DataFrame:
    """Dataset B: Dataset A without the label's source column."""
    return labeled.drop(leak_column)


def assert_no_leakage(df: DataFrame, leak_column: str = LEAK_COLUMN) -> DataFrame:
    if leak_column in df.columns:
        raise LeakageError(f"target leakage: '{leak_column}' is present in the training table")
    return df


def class_distribution(labeled: DataFrame, target: str = TARGET) -> DataFrame:
    """One row: labelled users (NULL labels excluded), churned, not churned and
    the two rates rounded to 4 places (0.0 on an empty table)."""
    y = F.col(target)
    agg = labeled.agg(F.count(y).alias("total_users"),
                      F.count_if(y == 1).alias("total_churned"),
                      F.count_if(y == 0).alias("total_non_churned"))
    n = F.col("total_users")
    return agg.select(
        "total_users", "total_churned", "total_non_churned",
        F.when(n > 0, F.round(F.col("total_churned") / n, 4)).otherwise(0.0).alias("churn_rate"),
        F.when(n > 0, F.round(F.col("total_non_churned") / n, 4)).otherwise(0.0).alias("non_churn_rate"))


def labeling_report(labeled: DataFrame, training: DataFrame,
                    threshold: float = CHURN_THRESHOLD_DAYS, target: str = TARGET,
                    leak_column: str = LEAK_COLUMN) -> DataFrame:
    """One row: threshold, all records (unlabelled included), churned, active,
    their percentages of the labelled rows (2 places) and whether the leak
    column is absent from the training table."""
    y = F.col(target)
    agg = labeled.agg(F.count(F.lit(1)).alias("total_records"), F.count(y).alias("_n"),
                      F.count_if(y == 1).alias("churned_users"),
                      F.count_if(y == 0).alias("active_users"))
    n = F.col("_n")
    return agg.select(
        F.lit(threshold).cast("int").alias("threshold_days"), "total_records",
        "churned_users", "active_users",
        F.when(n > 0, F.round(F.col("churned_users") * 100.0 / n, 2)).otherwise(0.0)
         .alias("churn_percentage"),
        F.when(n > 0, F.round(F.col("active_users") * 100.0 / n, 2)).otherwise(0.0)
         .alias("active_percentage"),
        F.lit(leak_column not in training.columns).alias("leakage_removed"))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in FEATURE_COLUMNS if c in df.columns]

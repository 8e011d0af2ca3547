"""Data-quality checks and repairs on feature tables.

Every check is one aggregation pass over all columns; the long per-column
layout is produced with ``unpivot`` on the single aggregated row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.numbers import finite_or_null

# Repair rules of the feature layer.
RATIO_COLUMNS = ["active_repo_ratio", "inactive_repo_ratio", "repository_maintenance_ratio"]
NON_NEGATIVE_COLUMNS = ["days_since_last_activity", "account_age_days", "repos_per_year",
                        "avg_stars_per_repo", "avg_forks_per_repo", "repo_activity_density"]

INF = float("inf")


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns with a numeric type (booleans and strings excluded)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def coerce_numeric(df: DataFrame, columns=None) -> DataFrame:
    """Non-numeric feature columns → DOUBLE via ``try_cast`` (bad text → NULL)."""
    columns = columns if columns is not None else [c for c in df.columns if c != "login"]
    out = []
    for f in df.schema.fields:
        if f.name in columns and not isinstance(f.dataType, T.NumericType):
            out.append(F.col(f.name).try_cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def validate_features(df: DataFrame, columns=None) -> DataFrame:
    """Label-side validation: coerce to numbers, NaN and ±inf → NULL (kept
    missing)."""
    columns = columns if columns is not None else [c for c in df.columns if c != "login"]
    df = coerce_numeric(df, columns)
    sch = df.schema
    out = []
    for f in sch.fields:
        if f.name in columns and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(finite_or_null(F.col(f.name)).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _clean(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(finite_or_null(c), F.lit(0.0)).cast(dtype)
    return F.coalesce(c, F.lit(0).cast(dtype))


def sanitise_features(df: DataFrame) -> DataFrame:
    """Feature-side repair: ±inf and NaN/NULL → 0, then the three ratios are
    clamped to [0, 1] and six columns to >= 0 (the follower ratio is left)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.NumericType):
            c = _clean(c, f.dataType)
            if f.name in RATIO_COLUMNS:
                c = F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)).cast(f.dataType)
            elif f.name in NON_NEGATIVE_COLUMNS:
                c = F.greatest(c, F.lit(0).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def quality_summary(df: DataFrame, columns=None) -> DataFrame:
    """Per numeric column: infinite, missing (NULL or NaN) and negative counts."""
    columns = columns if columns is not None else numeric_columns(df)
    aggs = []
    for c in columns:
        d = F.col(c).cast("double")
        aggs += [F.count_if(F.abs(d) == F.lit(INF)).alias(f"{c}__inf"),
                 F.count_if(d.isNull() | F.isnan(d)).alias(f"{c}__missing"),
                 F.count_if(d < 0).alias(f"{c}__negative")]
    row = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__inf").alias("n_inf"),
                 F.col(f"{c}__missing").alias("n_missing"),
                 F.col(f"{c}__negative").alias("n_negative")) for c in columns]))
    return row.select(stacked.alias("s")).select("s.*")


# Accepted ranges of the nine scoring inputs.
RANGE_RULES = {
    "account_age_days": (0.0, None),
    "repos_per_year": (0.0, None),
    "followers_following_ratio": (0.0, None),
    "active_repo_ratio": (0.0, 1.0),
    "inactive_repo_ratio": (0.0, 1.0),
    "avg_stars_per_repo": (0.0, None),
    "avg_forks_per_repo": (0.0, None),
    "repo_activity_density": (0.0, None),
    "repository_maintenance_ratio": (0.0, 1.0),
}


def range_violation(rules=None) -> Column:
    """Text listing the violated rules of a row, NULL when the row is valid."""
    rules = rules or RANGE_RULES
    msgs = []
    for c, (lo, hi) in rules.items():
        v = F.col(c).cast("double")
        bad = v.isNull() | F.isnan(v)
        if lo is not None:
            bad = bad | (v < lo)
        if hi is not None:
            bad = bad | (v > hi)
        msgs.append(F.when(bad, F.lit(c)))
    joined = F.concat_ws(",", *msgs)
    return F.when(joined != "", joined)


def range_check(df: DataFrame, rules=None) -> DataFrame:
    """Adds ``violations`` (NULL when valid) and ``valid``; split with a filter."""
    v = range_violation(rules)
    return df.withColumn("violations", v).withColumn("valid", F.col("violations").isNull())


def range_reasons(rules=None) -> Column:
    """Array of (column, reason) of the violated rules of a row: ``missing``
    (NULL, NaN or no number), ``below`` or ``above`` its range."""
    rules = rules or RANGE_RULES
    found = []
    for c, (lo, hi) in rules.items():
        v = F.col(c).try_cast("double")
        reason = F.when(v.isNull() | F.isnan(v), F.lit("missing"))
        if lo is not None:
            reason = reason.when(v < lo, F.lit("below"))
        if hi is not None:
            reason = reason.when(v > hi, F.lit("above"))
        found.append(F.when(reason.isNotNull(), F.struct(F.lit(c).alias("column"), reason.alias("reason"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def quarantine(df: DataFrame, path: str, rules=None) -> tuple[DataFrame, DataFrame]:
    """Write valid and rejected rows in one pass over ``df`` (two partitions
    of one table) and read them back: (accepted rows with the columns of
    ``df``, rejected rows with ``reasons``). Every row is in exactly one of the
    two."""
    checked = df.withColumn("reasons", range_reasons(rules))
    checked = checked.withColumn("accepted", F.size("reasons") == 0)
    checked.write.partitionBy("accepted").parquet(path)
    back = df.sparkSession.read.schema(checked.schema).parquet(path)
    return back.where("accepted").select(*df.columns), back.where("NOT accepted").drop("accepted")


def rejection_report(rejected: DataFrame) -> DataFrame:
    """Rejected rows per (column, reason); a row counts once per violated rule."""
    return rejected.select(F.explode("reasons").alias("r")).groupBy("r.column", "r.reason").agg(
        F.count(F.lit(1)).alias("n"))

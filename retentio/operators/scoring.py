"""Batch scoring: align a feature table to a model, score every row, and
format probability, percentage, tier and action.

Scoring is a narrow transformation (no shuffle), so it works unchanged on a
streaming DataFrame."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.schemas import ID_COLUMNS, LEAKY_COLUMNS

# Probability cut-offs of the risk tiers.
HIGH_RISK = 0.6
MEDIUM_RISK = 0.3


def prediction_features(features: DataFrame) -> DataFrame:
    """Scoring input: the feature table without login and the leaky columns."""
    return features.drop(*[c for c in [*ID_COLUMNS, *LEAKY_COLUMNS] if c in features.columns])


def align_features(df: DataFrame, expected: list[str], keep: tuple[str, ...] = (),
                   leaky=tuple(LEAKY_COLUMNS)) -> DataFrame:
    """Leaky columns dropped, missing expected columns added as 0.0, missing,
    NaN and infinite values filled with 0.0, extra columns dropped, order = ``expected`` (``keep`` columns pass through)."""
    present = set(df.columns) - set(leaky)
    from retentio.functions.numbers import finite_or_null
    cols = [F.coalesce(finite_or_null(F.col(c)), F.lit(0.0)).alias(c) if c in present else F.lit(0.0).alias(c)
            for c in expected]
    return df.select(*[F.col(k) for k in keep], *cols)


def risk_tier(p: Column) -> Column:
    return (F.when(p > HIGH_RISK, "high").when(p > MEDIUM_RISK, "medium").otherwise("low"))


def percent_text(p: Column) -> Column:
    """``'12.3%'``: the 4-place probability times 100, rounded half-up to one
    decimal on the exact decimal value (a binary tie such as 0.25 % gives
    0.3 %)."""
    pct = F.round(p.cast("decimal(10,4)") * 100, 1).cast("decimal(6,1)")
    return F.concat(pct.cast("string"), F.lit("%"))


def score_columns(prob: Column) -> list[Column]:
    p = F.round(prob, 4)
    return [p.alias("churn_probability"), (prob > 0.5).alias("churned"),
            percent_text(p).alias("churn_percentage"), risk_tier(p).alias("risk_tier"),
            F.when(prob > 0.5, "High Risk").otherwise("Low Risk").alias("status")]


def retention_action(p: Column, value: Column | None = None, value_floor: float = 0.0) -> Column:
    """Tiered intervention: borderline risk → low-cost, stronger signal →
    moderate, high-touch only where the user's value justifies it."""
    justified = F.lit(True) if value is None else F.coalesce(value > value_floor, F.lit(False))
    return (F.when(p > HIGH_RISK, F.when(justified, "high-touch").otherwise("moderate"))
             .when(p > MEDIUM_RISK, "moderate")
             .when(p > 0.0, "low-cost")
             .otherwise("none"))


def batch_score(model: PipelineModel, features: DataFrame, key: str = "login") -> DataFrame:
    """(login, churn_probability, churned, churn_percentage, risk_tier, status)."""
    from pyspark.ml.functions import vector_to_array
    expected = list(model.stages[0].getInputCols())
    aligned = align_features(features, expected, keep=(key,))
    scored = model.transform(aligned)
    prob = vector_to_array(F.col("probability"))[1]
    return scored.select(key, *score_columns(prob))

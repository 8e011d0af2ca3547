"""Exact stratified hold-out split, stratified folds and class weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.operators.ordering import hashed_rank
from retentio.session import write_once


MAX_CLASSES = 1000


def _class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class on the driver; a column with more than ``MAX_CLASSES``
    values is no class label and raises."""
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values: not a class label")
    return {r[0]: r[1] for r in rows}


def allocate(counts: dict, n_draws: int) -> dict:
    """Proportional allocation of ``n_draws`` over classes, left-over draws
    by largest remainder, ties to the smaller label."""
    total = sum(counts.values())
    cont = {c: n_draws * n / total for c, n in counts.items()}
    out = {c: math.floor(v) for c, v in cont.items()}
    need = n_draws - sum(out.values())
    for c in sorted(counts, key=lambda c: (-(cont[c] - out[c]), c))[:need]:
        out[c] += 1
    return out


def split_sizes(counts: dict, test_size: float = 0.2) -> dict:
    """Per-class test rows: test = ⌈test_size·n⌉, train allocated first."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    train = allocate(counts, n - n_test)
    return {c: counts[c] - train[c] for c in counts}


def stratified_split(df: DataFrame, label: str = "churn", key: str = "login",
                     test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: exactly the allocated number of rows per class, the
    first ones in a seeded hash order of ``key``. Rows with a NULL label are
    removed."""
    # written once: the class counts, the rank offsets and the rows read it
    df = write_once(df.where(F.col(label).isNotNull()), "split-input")
    sizes = split_sizes(_class_counts(df, label), test_size)
    cut = F.create_map(*[x for c, n in sizes.items() for x in (F.lit(c), F.lit(n))])
    ranked = hashed_rank(df, [label], F.col(key), seed)
    return ranked.withColumn("is_test", F.col("_rank") < cut[F.col(label)]).drop("_rank")


def stratified_folds(df: DataFrame, label: str = "churn", key: str = "login",
                     k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in [0, k): rank inside the class (seeded hash order) mod
    k, so fold sizes per class differ by at most one."""
    df = write_once(df.where(F.col(label).isNotNull()), "fold-input")
    ranked = hashed_rank(df, [label], F.col(key), seed)
    return ranked.withColumn("fold", F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_rank")


def class_weights(df: DataFrame, label: str = "churn") -> DataFrame:
    """'balanced' weights n / (k · n_c): (label, n, weight)."""
    counts = _class_counts(df.where(F.col(label).isNotNull()), label)
    n, k = sum(counts.values()), len(counts)
    rows = [(c, m, n / (k * m)) for c, m in sorted(counts.items())]
    typ = dict(df.dtypes)[label]
    return df.sparkSession.createDataFrame(rows, f"{label} {typ}, n long, weight double")


def with_class_weights(df: DataFrame, label: str = "churn", weight_col: str = "weight") -> DataFrame:
    """Adds the balanced weight of each row's class (a literal map of one
    entry per class, no join)."""
    counts = _class_counts(df.where(F.col(label).isNotNull()), label)
    n, k = sum(counts.values()), len(counts)
    m = F.create_map(*[x for c, cnt in counts.items() for x in (F.lit(c), F.lit(n / (k * cnt)))])
    return df.withColumn(weight_col, m[F.col(label)])

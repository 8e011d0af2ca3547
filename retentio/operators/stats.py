"""Feature statistics: describe, variance, correlation, histograms, counts.

All statistics of all columns are computed in as few aggregation passes as
possible (one ``agg`` for every variance, one for every correlation pair).
Quantiles are exact: ``exact_quantiles`` narrows value ranges with bucketed
counts (each round one distributed aggregation whose result is at most
targets × buckets rows) instead of gathering a column into one task.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.functions.numbers import finite_or_null, nan_to_null
from retentio.session import write_once

# Output precision of floating statistics in report tables.
DIGITS = 6


def _long(row_df: DataFrame, columns, fields) -> DataFrame:
    """One aggregated row with ``{col}__{field}`` columns → one row per col."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("ordinal"),
                             *[F.col(f"{c}__{f}").alias(f) for f in fields])
                    for i, c in enumerate(columns)])
    return row_df.select(F.explode(arr).alias("s")).select("s.*")


def exact_quantiles(df: DataFrame, columns, probs=(0.25, 0.5, 0.75), buckets: int = 512,
                    cache: bool = True, extra_aggs=()):
    """Exact linear-interpolated quantiles (pandas / ``quantile_cont``).

    Returns ``({(column, prob): value}, stats_row)``; ``stats_row`` also holds
    ``extra_aggs`` evaluated on the NaN-free columns in the same first pass.
    Each round is one job: rank targets that search the same value range
    share one bucket histogram (at most ranges × buckets rows reach the
    driver), and a range shrinks to the least and largest value of the
    target's bucket, until it holds one value. Infinite values are counted
    apart and stand before and after all others; NaN counts as missing.
    """
    vals = df.select(*[nan_to_null(F.col(c)).alias(c) for c in columns])
    if cache:
        vals = vals.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _exact_quantiles(vals, columns, probs, buckets, extra_aggs)
    finally:
        if cache:
            vals.unpersist()


def _exact_quantiles(vals, columns, probs, buckets, extra_aggs):
    inf = float("inf")

    def finite(c):
        return F.when(F.abs(F.col(c)) != inf, F.col(c))

    stats = vals.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
                     *[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)],
                     *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)],
                     *[F.min(finite(c)).alias(f"flo{i}") for i, c in enumerate(columns)],
                     *[F.max(finite(c)).alias(f"fhi{i}") for i, c in enumerate(columns)],
                     *[F.count_if(F.col(c) == -inf).alias(f"neg{i}") for i, c in enumerate(columns)],
                     *[F.count_if(F.col(c) == inf).alias(f"pos{i}") for i, c in enumerate(columns)],
                     *extra_aggs).first()
    targets = {}
    for i, c in enumerate(columns):
        n = stats[f"n{i}"]
        if not n:
            continue
        for q in probs:
            pos = (n - 1) * q
            for r in {math.floor(pos), min(math.floor(pos) + 1, n - 1)}:
                t = {"lo": stats[f"flo{i}"], "hi": stats[f"fhi{i}"], "below": stats[f"neg{i}"], "value": None}
                if r < stats[f"neg{i}"]:
                    t["value"] = -inf
                elif r >= n - stats[f"pos{i}"]:
                    t["value"] = inf
                targets[(i, r)] = t
    while True:
        for s in targets.values():
            if s["value"] is None and s["lo"] == s["hi"]:
                s["value"] = s["lo"]
        open_t = [(k, s) for k, s in targets.items() if s["value"] is None]
        if not open_t:
            break
        # targets that search the same (column, range) share one histogram
        ranges = sorted({(i, s["lo"], s["hi"], s["below"]) for (i, _), s in open_t})
        rid = {rg: g for g, rg in enumerate(ranges)}
        parts = []
        for g, (i, lo, hi, _) in enumerate(ranges):
            v = F.col(columns[i])
            # halves keep the width finite for any two doubles
            width = float(hi) / 2 - float(lo) / 2
            place = F.least((v / 2 - F.lit(float(lo) / 2)) / F.lit(width), F.lit(1.0)) if width else (v > lo).cast("double")
            b = F.least(F.floor(place * buckets), F.lit(buckets - 1))
            parts.append(F.when((v >= lo) & (v <= hi),
                                F.struct(F.lit(g).alias("g"), b.cast("int").alias("b"), v.alias("v"))))
        counts = (vals.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x"))
                  .groupBy("x.g", "x.b")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("mn"), F.max("x.v").alias("mx"))
                  .toPandas())
        hist: dict[int, list] = {}
        for row in counts.sort_values(["g", "b"]).to_dict("records"):
            hist.setdefault(int(row["g"]), []).append(row)
        for (i, r), s in open_t:
            cum = s["below"]
            for row in hist.get(rid[(i, s["lo"], s["hi"], s["below"])], []):
                if cum + row["n"] > r:
                    if (row["mn"], row["mx"]) == (s["lo"], s["hi"]):
                        raise ArithmeticError(f"{columns[i]}: the range {s['lo']}..{s['hi']} does not shrink")
                    s["lo"], s["hi"], s["below"] = row["mn"], row["mx"], cum
                    break
                cum += int(row["n"])
    out = {}
    for i, c in enumerate(columns):
        n = stats[f"n{i}"]
        for q in probs:
            if not n:
                out[(c, q)] = None
                continue
            pos = (n - 1) * q
            f = math.floor(pos)
            a = targets[(i, f)]["value"]
            b = targets[(i, min(f + 1, n - 1))]["value"]
            out[(c, q)] = a if a == b or pos == f else a + (b - a) * (pos - f)
    return out, stats


def describe(df: DataFrame, columns=None, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Per column: count, mean, std (sample), min, 25%, 50%, 75%, max.
    Moments ride along with the first pass of the exact quantile search.
    ``exact=False`` takes the quartiles from one ``percentile_approx`` pass
    (rank error about 1/accuracy, no interpolation)."""
    from retentio.operators.quality import numeric_columns
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not exact:
        return _describe_approx(df, columns, accuracy)
    moments = []
    for i, c in enumerate(columns):
        moments += [F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}")]
    q, st = exact_quantiles(df, columns, extra_aggs=moments)

    def r6(x):
        return None if x is None else round(float(x), DIGITS)

    rows = [(c, int(st[f"n{i}"]), r6(st[f"mean{i}"]), r6(st[f"std{i}"]),
             None if st[f"lo{i}"] is None else float(st[f"lo{i}"]),
             r6(q.get((c, 0.25))), r6(q.get((c, 0.5))), r6(q.get((c, 0.75))),
             None if st[f"hi{i}"] is None else float(st[f"hi{i}"]))
            for i, c in enumerate(columns)]
    # one row per column: the p statistics come back as a small table
    return df.sparkSession.createDataFrame(
        rows, "feature string, count long, mean double, std double, min double, p25 double, "
              "p50 double, p75 double, max double")


def _describe_approx(df: DataFrame, columns, accuracy: int) -> DataFrame:
    vals = df.select(*[nan_to_null(F.col(c)).alias(c) for c in columns])
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"{c}__count"), F.round(F.avg(c), DIGITS).alias(f"{c}__mean"),
                 F.round(F.stddev_samp(c), DIGITS).alias(f"{c}__std"), F.min(c).alias(f"{c}__min"),
                 F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy).alias(f"{c}__q"),
                 F.max(c).alias(f"{c}__max")]
    row = vals.agg(*aggs)
    out = _long(row, columns, ["count", "mean", "std", "min", "q", "max"])
    return out.select("feature", "count", "mean", "std", "min",
                      F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
                      F.col("q")[2].alias("p75"), "max")


def variance(df: DataFrame, columns=None) -> DataFrame:
    """Population variance of every column in one pass: (feature, ordinal, variance)."""
    from retentio.operators.quality import numeric_columns
    columns = list(columns) if columns is not None else numeric_columns(df)
    row = df.agg(*[F.var_pop(nan_to_null(F.col(c))).alias(f"{c}__variance") for c in columns])
    return _long(row, columns, ["variance"])


#: Columns up to which every pair gets its own aggregates (one pass, codegen).
PAIR_COLUMNS = 24
#: Cells of a strip of the pair matrix that a task adds up at a time.
STRIP_CELLS = 1 << 20


def correlation_pairs(df: DataFrame, columns=None) -> DataFrame:
    """Pearson r for all pairs i < j, pairwise-complete (rows where both are
    present, NaN counts as missing). A column that is constant on those rows,
    or infinite in one of them, gives NULL.
    (feature_a, feature_b, ordinal_a, ordinal_b, corr).

    Up to ``PAIR_COLUMNS`` columns: one aggregation pass. Beyond: strips of
    the pair matrix, see :func:`strip_correlations`; no p x p sums reach the
    driver in either case.
    """
    from retentio.operators.quality import numeric_columns
    columns = list(columns) if columns is not None else numeric_columns(df)
    if len(columns) > PAIR_COLUMNS:
        r = strip_correlations(df, columns)
    else:
        r = _pair_correlations(df, columns)
    names = F.array(*[F.lit(c) for c in columns])
    return r.select(F.get(names, F.col("ordinal_a")).alias("feature_a"), F.get(names, F.col("ordinal_b")).alias("feature_b"),
                    "ordinal_a", "ordinal_b", "corr")


def _pair_correlations(df: DataFrame, columns) -> DataFrame:
    v = df.select(*[nan_to_null(F.col(c)).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    pairs = list(combinations(range(len(columns)), 2))
    kind = "ordinal_a int, ordinal_b int, corr double"
    if not pairs:
        return df.sparkSession.createDataFrame([], kind)
    aggs = []
    for i, j in pairs:
        a, b = F.col(f"x{i}"), F.col(f"x{j}")
        aggs += [F.covar_pop(a, b).alias(f"c{i}_{j}"), F.var_pop(F.when(b.isNotNull(), a)).alias(f"a{i}_{j}"),
                 F.var_pop(F.when(a.isNotNull(), b)).alias(f"b{i}_{j}")]

    def corr(i, j):
        va, vb = F.col(f"a{i}_{j}"), F.col(f"b{i}_{j}")
        return F.when((va > 0) & (vb > 0), finite_or_null(F.col(f"c{i}_{j}") / (F.sqrt(va) * F.sqrt(vb))))

    rows = F.array(*[F.struct(F.lit(i).alias("ordinal_a"), F.lit(j).alias("ordinal_b"), corr(i, j).alias("corr"))
                     for i, j in pairs])
    return v.agg(*aggs).select(F.explode(rows).alias("p")).select("p.*")


def strip_correlations(df: DataFrame, columns, cells: int = STRIP_CELLS) -> DataFrame:
    """(ordinal_a, ordinal_b, corr) of all column pairs a < b for wide tables.

    The rows are written once, as arrays. Per strip of rows of the pair matrix,
    tasks add up six matrices (numpy) over their rows; a task holds one strip,
    at most ``cells`` cells (or one row). Per column its partial rows meet in
    one task, which adds them one by one and computes the coefficients. The
    driver sees the sums behind p means.
    """
    p = len(columns)
    # NaN and null are both missing (both arrive as NaN)
    vals = write_once(df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v")), "wide")

    def matrix(rb):
        flat = rb.column(0).values.to_numpy(zero_copy_only=False)[rb.column(0).offset * p:]
        return np.asarray(flat, float)[:rb.num_rows * p].reshape(-1, p)

    def totals(batches):
        sums = np.zeros((2, p))
        for rb in batches:
            x = matrix(rb)
            ok = np.isfinite(x)
            sums += [np.where(ok, x, 0.0).sum(axis=0), ok.sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    def merged(batches):
        sums = np.zeros((2, p))
        for rb in batches:
            for raw in rb.column(0):
                sums += np.frombuffer(raw.as_buffer(), np.float64).reshape(2, p)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    # subtracting the means keeps the sums of squares exact enough
    few = vals.mapInArrow(totals, "sums binary").repartition(8).mapInArrow(merged, "sums binary").collect()
    total, n = sum((np.frombuffer(r["sums"], np.float64).reshape(2, p) for r in few), np.zeros((2, p)))
    shift = total / np.maximum(n, 1)
    height = max(1, cells // p)

    def strip(lo):
        own = slice(0, min(height, p - lo))

        def add(batches):
            sums = None
            for rb in batches:
                x = matrix(rb)[:, lo:] - shift[lo:]
                there, wild = ~np.isnan(x), np.isinf(x)
                x[~there | wild] = 0.0
                m, sq = there.astype(float), x * x
                part = [m[:, own].T @ m, x[:, own].T @ m, m[:, own].T @ x, sq[:, own].T @ m, m[:, own].T @ sq, x[:, own].T @ x]
                if wild.any():  # no coefficient for pairs with an infinite value
                    w = wild.astype(float)
                    part[5][(w[:, own].T @ m + m[:, own].T @ w) > 0] = np.nan
                sums = part if sums is None else [s + t for s, t in zip(sums, part)]
            if sums is not None:
                both = np.stack(sums, axis=1)  # (own column, matrix, other column)
                for k in range(len(both)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lo + k], pa.int32()), pa.array([both[k, :, k + 1:].tobytes()], pa.binary())],
                        ["ordinal_a", "sums"])

        return vals.mapInArrow(add, "ordinal_a int, sums binary")

    def combine(batches):
        sums: dict[int, np.ndarray] = {}
        for rb in batches:
            for a, raw in zip(rb.column(0).to_pylist(), rb.column(1)):
                part = np.frombuffer(raw.as_buffer(), np.float64).reshape(6, -1)
                sums[a] = sums[a] + part if a in sums else part
        for a, (n, sa, sb, saa, sbb, sab) in sums.items():
            with np.errstate(all="ignore"):
                va, vb = saa - sa * sa / n, sbb - sb * sb / n
                r = (sab - sa * sb / n) / np.sqrt(va * vb)
                # the shift's own rounding is no variance
                real = (va > 1e-24 * n * (1e-30 + shift[a] ** 2)) & (vb > 1e-24 * n * (1e-30 + shift[a + 1:] ** 2))
            gone = ~real | ~np.isfinite(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(r), a, np.int32)), pa.array(np.arange(a + 1, p, dtype=np.int32)),
                 pa.array(np.where(gone, 0.0, r), pa.float64(), mask=gone)], ["ordinal_a", "ordinal_b", "corr"])

    parts = reduce(DataFrame.unionByName, [strip(lo) for lo in range(0, p, height)])
    return parts.repartition("ordinal_a").mapInArrow(combine, "ordinal_a int, ordinal_b int, corr double")


def target_distribution(df: DataFrame, target: str = "churn") -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).orderBy(target)


def majority_baseline(df: DataFrame, target: str = "churn") -> DataFrame:
    """Accuracy of always predicting the most frequent labelled class."""
    d = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.max_by(target, F.struct("n", -F.col(target))).alias("majority_class"),
                 F.max("n").alias("majority_count"), F.sum("n").alias("labelled"),
                 F.round(F.max("n") / F.sum("n"), 4).alias("majority_accuracy"))


def ratio_histogram(df: DataFrame, column: str = "active_repo_ratio", by: str = "churn",
                    bins: int = 20, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Counts per (bin, class); the upper edge falls into the last bin."""
    b = F.least(F.width_bucket(F.col(column), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return (df.where(F.col(column).isNotNull())
            .groupBy(b.alias("bin"), F.col(by)).agg(F.count(F.lit(1)).alias("n")))


def collection_summary(raw_users: DataFrame) -> DataFrame:
    """users, Σ repositories, mean repositories, mean followers, Σ active,
    Σ inactive over the collected records."""
    def num(c):
        return F.col(c).try_cast("double") if dict(raw_users.dtypes)[c] == "string" else F.col(c)
    return raw_users.agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("total_repositories").alias("total_repositories"),
        F.round(F.avg("total_repositories"), DIGITS).alias("avg_repositories"),
        F.round(F.avg(num("followers")), DIGITS).alias("avg_followers"),
        F.sum("active_repositories").alias("active_repositories"),
        F.sum("inactive_repositories").alias("inactive_repositories"))

"""Exact global ordering without a single-partition window.

Rows get a bucket that is monotone in the sort key. Per-bucket totals (at
most groups × buckets rows) give each bucket its offset; only the rows of one
bucket are then ordered together. Running counts and ranks stay exact while
every window partition is a bucket, never a whole class or table.

Buckets of values are Spark's range partitions: their boundaries are sampled
quantiles of (group, value), so outliers and heavy groups do not crowd a
bucket. Buckets of shuffles are leading digits of a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.session import small_side, write_once

HASH_DIGITS = 3


def range_bucketed(df: DataFrame, columns: list[str], bucket: str = "_vb",
                   buckets: int | None = None) -> DataFrame:
    """``df`` with a bucket number that is monotone in ``columns``: sampled
    quantile ranges. Written once, because a recomputed sample may cut
    elsewhere."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *columns).withColumn(bucket, F.spark_partition_id())
    return write_once(ranged, "ranged")


def running_sums(df: DataFrame, groups: list[str], bucket: str, order: list,
                 values: dict[str, Column]) -> DataFrame:
    """Adds ``{name}_before`` = Σ value over rows of the same group that come
    earlier in (bucket, *order); exclusive, exact, bucket-local windows.

    The offsets table has groups × buckets rows. It is broadcast when a count
    shows that it is small; otherwise a shuffle join on (group, bucket) also
    serves the bucket windows that follow.
    """
    tot = df.groupBy(*groups, bucket).agg(*[F.sum(v).alias(k) for k, v in values.items()])
    w_off = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_side(tot.select(*groups, bucket,
                                    *[F.coalesce(F.sum(k).over(w_off), F.lit(0)).alias(f"{k}_off")
                                      for k in values]))
    joined = df.join(offsets, [*groups, bucket])
    w_in = (Window.partitionBy(*groups, bucket).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, -1))
    out = joined
    for k, v in values.items():
        out = out.withColumn(f"{k}_before",
                             F.col(f"{k}_off") + F.coalesce(F.sum(v).over(w_in), F.lit(0)))
    return out.drop(*[f"{k}_off" for k in values])


def hashed_rank(df: DataFrame, groups: list[str], key: Column, seed: int = 42,
                digits: int = HASH_DIGITS) -> DataFrame:
    """0-based rank of each row inside its group, ordered by
    (md5 of key and seed, key): a seeded shuffle that is exact and stable."""
    text = key.cast("string")
    d = df.withColumn("_h", F.md5(F.concat(text, F.lit(f"|{seed}")))) \
          .withColumn("_hb", F.substring("_h", 1, digits)).withColumn("_hk", text)
    out = running_sums(d, groups, "_hb", [F.col("_h"), F.col("_hk")], {"_one": F.lit(1)})
    return out.withColumnRenamed("_one_before", "_rank").drop("_h", "_hb", "_hk")


def ordered_rank(df: DataFrame, groups: list[str], order_col: str,
                 buckets: int | None = None) -> DataFrame:
    """0-based rank inside each group by ``order_col`` (ties by row order of
    the column value only; give a unique column for a strict order)."""
    d = range_bucketed(df, [*groups, order_col], buckets=buckets)
    out = running_sums(d, groups, "_vb", [F.col(order_col)], {"_one": F.lit(1)})
    return out.withColumnRenamed("_one_before", "_rank").drop("_vb")

"""Incremental ingest of landed raw user files.

Files arriving in a folder are read with ``readStream``; each micro-batch is
appended to a batch log (``batch_id=N`` partition, overwritten on replay, so
a re-run batch is idempotent). The current table is the log reduced to the
latest record per case-insensitive login (latest ``scraped_at``, then the
latest batch). Appends never rewrite old data, so a batch costs its own size,
not the size of the table.

Readers need not reduce the log: :func:`merge_batch` keeps the current records
in a table bucketed by the hash of the login, where a batch rewrites only the
buckets of its own logins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.schemas import RAW_USER
from retentio.session import drop_written, path_exists, write_once


# The log and the tables hold nested records as text: half of snappy's size.
CODEC = "zstd"

# Position of a record in the landed files, kept in the log.
POSITION = ["_file", "_block", "_row"]


def _append_batch(log_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("_row", F.monotonically_increasing_id())
         .withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", CODEC).partitionBy("batch_id").parquet(log_path))
    return write


def bucket_of(key: str, n_buckets: int):
    """Bucket of a case-insensitive key."""
    return F.pmod(F.xxhash64(F.lower(F.col(key))), F.lit(n_buckets)).cast("int")


def merge_batch(spark: SparkSession, log_path: str, batch_id: int, table: str, n_buckets: int = 64,
                key: str = "login") -> None:
    """Merge one batch of the log into the bucketed table of current records.

    Only the buckets of the batch's logins are read and replaced; the files of
    all others stay. Records keep their stamps, so the merge picks the same
    winners as a reduction of the whole log. A batch that is merged again gives
    the same table. Merged buckets are written aside before they replace the
    old ones; the log stays the source from which a table is made anew
    (``n_buckets`` is fixed per table).
    """
    new = spark.read.parquet(log_path).where((F.col("batch_id") == batch_id) & (F.coalesce(F.col(key), F.lit("")) != ""))
    new = new.withColumn("bucket", bucket_of(key, n_buckets))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most n_buckets
    if not touched:
        return
    if path_exists(spark, table):
        old = spark.read.schema(new.schema).parquet(table).where(F.col("bucket").isin(touched))
        new = old.where(F.col("batch_id") != batch_id).unionByName(new)
    staged = write_once(_latest(new, key), "buckets", CODEC)
    (staged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", CODEC).partitionBy("bucket").parquet(table))
    drop_written(staged)


def bucketed_users(spark: SparkSession, table: str) -> DataFrame:
    """The current records of a bucketed table, all parts."""
    return spark.read.parquet(table).drop("bucket", "batch_id", *POSITION)


def run_bucketed_ingest(spark: SparkSession, landing: str, log_path: str, checkpoint: str, table: str,
                        n_buckets: int = 64, files_per_trigger: int | None = None, schema=RAW_USER) -> None:
    """Take in the files that have arrived since the last run: each
    micro-batch goes to the log and is merged into the bucketed table."""
    append = _append_batch(log_path)

    def take(batch: DataFrame, batch_id: int) -> None:
        append(batch, batch_id)
        merge_batch(batch.sparkSession, log_path, batch_id, table, n_buckets)

    stream = spark.readStream.schema(schema)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    stream = stream.json(landing).select("*", F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_block_start").alias("_block"))
    (stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def start_ingest(spark: SparkSession, landing: str, log_path: str, checkpoint: str,
                 files_per_trigger: int = 1, schema=RAW_USER):
    """Start an ``availableNow`` stream: every file present is processed, in
    batches of ``files_per_trigger`` files, then the query stops."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .json(landing)
              .select("*", F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block")))
    return (stream.writeStream.foreachBatch(_append_batch(log_path))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_users(spark: SparkSession, log_path: str, key: str = "login",
                  base: str | None = None) -> DataFrame:
    """Latest record per lower(login), with all its parts: the latest
    ``scraped_at``, then the latest batch, then the latest place in the batch.

    The winner is found on (login, stamp) alone: the part 0 that comes last.
    Its parts are the rows of the same spelling, stamp and batch; where a
    record is there twice, the later row of each part counts. ``base`` is a
    table written by :func:`compact`; only later batches are then read from
    the log.
    """
    return _latest(_rows(spark, log_path, base, key), key).drop(*POSITION)


def compact(spark: SparkSession, log_path: str, path: str, key: str = "login",
            base: str | None = None) -> str:
    """Write the current records with their stamps to ``path``, to read in
    place of the batches up to now."""
    _latest(_rows(spark, log_path, base, key), key).write.parquet(path)
    return path


def _rows(spark, log_path, base, key):
    log = spark.read.parquet(log_path).where(F.coalesce(F.col(key), F.lit("")) != "")
    if base is None:
        return log
    old = spark.read.parquet(base)
    last = old.agg(F.max("batch_id")).first()[0]
    return old.unionByName(log.where(F.col("batch_id") > F.lit(-1 if last is None else last)))


def _latest(log: DataFrame, key: str) -> DataFrame:
    part = F.coalesce(F.col("part"), F.lit(0)) if "part" in log.columns else F.lit(0)
    rows = log.withColumn("_k", F.lower(F.col(key))).withColumn("_part", part)
    # found on the narrow columns; the records themselves move once, to their places
    slim = rows.select("_k", "_part", key, "scraped_at", "batch_id", *POSITION)
    win = slim.where("_part = 0").groupBy("_k").agg(
        F.max(F.struct("scraped_at", "batch_id", *POSITION, key)).alias("w")).select(
        F.col("_k").alias("wk"), F.col(f"w.{key}").alias("wl"), F.col("w.scraped_at").alias("ws"),
        F.col("w.batch_id").alias("wb"))
    same = ((F.col("_k") == F.col("wk")) & (F.col(key) == F.col("wl")) & (F.col("batch_id") == F.col("wb"))
            & F.col("scraped_at").eqNullSafe(F.col("ws")))
    place = slim.join(win, same).groupBy("wk", "_part", "wl", "ws", "wb").agg(
        F.max(F.struct(*POSITION)).alias("p")).withColumnRenamed("_part", "pp").select(
        "wk", "pp", "wl", "ws", "wb", *[F.col(f"p.{c}").alias(f"p{c}") for c in POSITION])
    at = same & (F.col("_part") == F.col("pp"))
    for c in POSITION:
        at = at & (F.col(c) == F.col(f"p{c}"))
    return rows.join(place, at).select(*log.columns)


def ingest_available(spark: SparkSession, landing: str, log_path: str, checkpoint: str,
                     files_per_trigger: int = 1) -> DataFrame:
    q = start_ingest(spark, landing, log_path, checkpoint, files_per_trigger)
    q.awaitTermination()
    return current_users(spark, log_path)

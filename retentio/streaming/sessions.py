"""Sessions of an event stream.

Arriving event files are read with ``readStream`` and grouped by user and
``session_window``; a session is closed, and appended to the session table,
when the watermark has passed its end. Between runs its open sessions lie in
the checkpoint, so a run may start anywhere in the stream: a session whose
events arrive in two runs is one session.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.operators.behavior import ERROR_EVENT, SESSION_GAP_MINUTES, VALUE_ACTION

EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                      T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())])


def sessions(events: DataFrame, delay: str, gap_minutes: int = SESSION_GAP_MINUTES,
             error: str = ERROR_EVENT, value_action: str = VALUE_ACTION) -> DataFrame:
    """user_id, start, last (times of the first and last event), actions,
    errors, value_actions per session of a stream (or a table). Events farther
    than ``delay`` behind the latest one are late and dropped by the stream;
    events a gap apart or nearer share a session."""
    # events without a user have no session; the closing event (no user, no kind) moves the watermark
    e = events.where(F.col("user_id").isNotNull() | (F.col("event_id").isNull() & F.col("event_type").isNull()))
    e = e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    s = e.groupBy(F.session_window("ts", f"{gap_minutes} minutes").alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("actions"), F.count_if(F.col("event_type") == error).alias("errors"),
        F.count_if(F.col("event_type") == value_action).alias("value_actions"))
    gap = F.make_dt_interval(mins=F.lit(gap_minutes))
    # not filtered by user here: the filter would be moved in front of the watermark
    return s.select(
        "user_id", F.col("w.start").cast("timestamp_ntz").alias("start"),
        (F.col("w.end") - gap).cast("timestamp_ntz").alias("last"), "actions", "errors", "value_actions")


def run_sessions(spark: SparkSession, landing: str, path: str, checkpoint: str, delay: str = "2 hours",
                 gap_minutes: int = SESSION_GAP_MINUTES, files_per_trigger: int | None = None) -> None:
    """Take in the files that have arrived since the last run and append the
    sessions that are closed by now to the table at ``path``, by the day of
    their start."""
    stream = spark.readStream.schema(EVENT)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    s = sessions(stream.parquet(landing), delay, gap_minutes).withColumn("day", F.to_date("start"))
    (s.writeStream.outputMode("append").format("parquet").partitionBy("day").option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def close_until(spark: SparkSession, landing: str, until: _dt.datetime, delay: _dt.timedelta,
                gap_minutes: int = SESSION_GAP_MINUTES) -> None:
    """Land one event without a user, late enough that the next run closes
    every session that starts before ``until``: a stream without arrivals has
    no clock of its own."""
    at = until + delay + 2 * _dt.timedelta(minutes=gap_minutes)
    spark.createDataFrame([(None, at, None, None)], EVENT).coalesce(1).write.mode("append").parquet(landing)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The closed sessions (only files that a finished batch wrote)."""
    return spark.read.parquet(path).where("user_id IS NOT NULL")


def sessions_started(closed: DataFrame, as_of, days: int) -> DataFrame:
    """Sessions per user that started in the last ``days`` days before
    ``as_of``; the bound prunes day partitions."""
    first = as_of - _dt.timedelta(days=days)
    c = closed.where((F.col("day") >= F.lit(first.date())) & (F.col("start") >= F.lit(first).cast("timestamp_ntz"))
                     & (F.col("start") < F.lit(as_of).cast("timestamp_ntz")))
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))

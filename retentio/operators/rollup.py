"""Dated per-user aggregates of events and the features merged from them.

A daily job reduces one day of events to mergeable per-user rows (counts,
module flags, session starts, first timestamps, a distinct-count sketch) and
writes them as a date partition. The event features of a day are merges of at
most 30 such partitions, so raw events are read once, whatever the number of
feature dates. A day depends on its own events and one session gap before
them only: days can be computed in any order, in ranges, and again; a day that
is computed again replaces its partition and no other.

Every computed day holds one row without a user (``mark``), so that a day
without events replaces what was there before, and a day that was never
computed is told from a silent one.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.operators.behavior import (
    ERROR_DAYS, ERROR_EVENT, ESSENTIAL_MODULES, MONTH_DAYS, SESSION_GAP_MINUTES, SHORT_DAYS, VALUE_ACTION,
    event_features, flags, session_starts)
from retentio.session import path_exists

DAY = _dt.timedelta(days=1)


def _day(d) -> _dt.date:
    if isinstance(d, _dt.datetime):
        if d.time() != _dt.time():
            raise ValueError(f"dated aggregates need whole days, got {d}")
        return d.date()
    return d


def daily_aggregates(events: DataFrame, first_day, last_day, user: str = "user_id", ts: str = "ts",
                     kind: str = "event_type", essential=ESSENTIAL_MODULES, value_action: str = VALUE_ACTION,
                     error: str = ERROR_EVENT, gap_minutes: int = SESSION_GAP_MINUTES, lg_k: int = 12) -> DataFrame:
    """One row per user and day (UTC) with an event: day, user, actions,
    modules (a bit per essential module), modules_sketch (distinct essential
    modules), value_actions, errors, sessions (started that day), first_event,
    first_value (timestamps).

    One scan of the events from one gap before ``first_day`` to the end of
    ``last_day``; events without a user are not counted.
    """
    if 24 * 60 % gap_minutes or len(essential) > 62:
        raise ValueError("the session gap must divide a day, and at most 62 modules fit the flags")
    first, last = _day(first_day), _day(last_day)
    start = F.lit(_dt.datetime.combine(first, _dt.time())).cast("timestamp_ntz")
    margin = F.make_dt_interval(mins=F.lit(gap_minutes))
    end = F.lit(_dt.datetime.combine(last + DAY, _dt.time())).cast("timestamp_ntz")
    e = events.where((F.col(ts) >= start - margin) & (F.col(ts) < end) & F.col(user).isNotNull())
    t, k = F.col(ts), F.col(kind)
    names = ["actions", "modules", "modules_sketch", "value_actions", "errors", "first_event", "first_value"]
    b = session_starts(e, start, user, ts, gap_minutes, [
        F.count(F.lit(1)), F.bit_or(flags(k, essential)),
        F.hll_sketch_agg(F.when(k.isin(list(essential)), k), F.lit(lg_k)),
        F.count_if(k == value_action), F.count_if(k == error), F.min(t), F.min(F.when(k == value_action, t))])
    a = dict(zip(names, [F.col(f"_a{i}") for i in range(len(names))]))
    # buckets divide days; those of the margin lie before the first day
    day = F.to_date(F.timestamp_seconds(F.col("bucket") * (gap_minutes * 60)))
    b = b.where(F.col("_first").isNotNull()).withColumn("day", day)
    return b.groupBy("day", user).agg(
        F.sum(a["actions"]).alias("actions"), F.bit_or(a["modules"]).alias("modules"),
        F.hll_union_agg(a["modules_sketch"]).alias("modules_sketch"),
        F.sum(a["value_actions"]).alias("value_actions"), F.sum(a["errors"]).alias("errors"),
        F.count_if("starts").alias("sessions"), F.min(a["first_event"]).alias("first_event"),
        F.min(a["first_value"]).alias("first_value")).withColumnRenamed(user, "user_id")


def _schema(user_type: T.DataType) -> T.StructType:
    s = T.StructType([T.StructField("user_id", user_type), T.StructField("actions", T.LongType()),
                      T.StructField("modules", T.LongType()), T.StructField("modules_sketch", T.BinaryType())])
    for c in ("value_actions", "errors", "sessions"):
        s = s.add(c, T.LongType())
    return s.add("first_event", T.TimestampNTZType()).add("first_value", T.TimestampNTZType()).add("day", T.DateType())


def write_rollup(events: DataFrame, first_day, last_day, path: str, user: str = "user_id", **kw) -> str:
    """Compute the days from ``first_day`` to ``last_day`` and replace their
    partitions of the table at ``path``; other days stay."""
    first, last = _day(first_day), _day(last_day)
    schema = _schema(events.schema[user].dataType)
    rows = daily_aggregates(events, first, last, user=user, **kw).select(*schema.names)
    marks = events.sparkSession.range((last - first).days + 1).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    marks = marks.select(*[F.col(f.name) if f.name == "day" else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in schema.fields])
    (rows.unionByName(marks).hint("rebalance", "day").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
    return path


def read_rollup(spark: SparkSession, path: str, first_day=None, last_day=None,
                user_type: T.DataType = T.LongType()) -> DataFrame:
    """The dated rows, marks included, between two days (only their
    partitions are read)."""
    r = spark.read.schema(_schema(user_type)).parquet(path)
    if first_day is not None:
        r = r.where(F.col("day") >= F.lit(_day(first_day)))
    if last_day is not None:
        r = r.where(F.col("day") <= F.lit(_day(last_day)))
    return r


def missing_days(spark: SparkSession, path: str, first_day, last_day) -> list[_dt.date]:
    """Days of the range that were never computed."""
    first, last = _day(first_day), _day(last_day)
    days = [first + DAY * k for k in range((last - first).days + 1)]
    if not path_exists(spark, path):
        return days
    there = {r["day"] for r in read_rollup(spark, path, first, last).where("user_id IS NULL")
             .select("day").distinct().collect()}
    return [d for d in days if d not in there]


def merge_firsts(rollup: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """First event and first value action per user (user_id, first_event,
    first_value): minima over dated rows and an earlier such table. Merging
    the same days again changes nothing, so only new days need to be read."""
    cols = ["user_id", "first_event", "first_value"]
    rows = rollup.where("user_id IS NOT NULL").select(*cols)
    if firsts is not None:
        rows = rows.unionByName(firsts.select(*cols))
    return rows.groupBy("user_id").agg(F.min("first_event").alias("first_event"), F.min("first_value").alias("first_value"))


def event_features_at(rollup: DataFrame, days, users: DataFrame | None = None, firsts: DataFrame | None = None,
                      n_modules: int = len(ESSENTIAL_MODULES), approximate: bool = False) -> DataFrame:
    """The event features of every day in ``days`` (as of its midnight) from
    dated rows, in one pass: (user_id, as_of, features).

    Each dated row counts for the feature dates of the next 30 days. Rows are
    dealt by user first and expanded to their dates inside the task, so the
    shuffle moves each row once; a user has at most one row per day. With
    ``users`` (one row per user) every user of it has a row per date, and only
    these; else users with an event in the frame. ``firsts``
    (:func:`merge_firsts`) adds signup and first value; without it the ghosting
    columns are null. ``approximate`` counts modules by the merged sketches.
    """
    days = sorted({_day(d) for d in days})
    if not days:
        raise ValueError("no feature dates")
    r = rollup.where(F.col("user_id").isNotNull() & (F.col("day") < F.lit(days[-1]))
                     & (F.col("day") >= F.lit(days[0] - MONTH_DAYS * DAY))).drop("first_event", "first_value")
    if firsts is not None:
        r = r.unionByName(firsts.select("user_id", "first_event", "first_value"), allowMissingColumns=True)
    if users is not None:
        r = r.unionByName(users.select("user_id", F.lit(True).alias("_listed")), allowMissingColumns=True)
    for c, kind in (("_listed", "boolean"), ("first_event", "timestamp_ntz"), ("first_value", "timestamp_ntz")):
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast(kind))
    dates = F.array(*[F.lit(d) for d in days])
    near = F.filter(dates, lambda d: (d > F.col("day")) & (d <= F.date_add("day", MONTH_DAYS)))
    r = r.repartition("user_id").withColumn("as_of", F.explode(F.when(F.col("day").isNull(), dates).otherwise(near)))
    age = F.datediff("as_of", "day")
    midnight = F.col("as_of").cast("timestamp_ntz")

    def total(c, within):
        return F.coalesce(F.sum(F.when(age <= within, F.col(c))), F.lit(0))

    if approximate:
        used = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("modules_sketch")), F.lit(0)).cast("long")
    else:
        used = F.bit_count(F.coalesce(F.bit_or("modules"), F.lit(0).cast("long"))).cast("long")
    p = r.groupBy("user_id", "as_of").agg(
        total("actions", SHORT_DAYS).alias("actions_7d"), total("actions", MONTH_DAYS).alias("actions_30d"),
        used.alias("modules_used"), total("value_actions", MONTH_DAYS).alias("value_actions"),
        F.count("day").alias("active_days"), total("errors", ERROR_DAYS).alias("errors_14d"),
        total("sessions", ERROR_DAYS).alias("sessions_14d"),
        F.min(F.when(F.col("first_event") < midnight, F.col("first_event"))).alias("signup"),
        F.min(F.when(F.col("first_value") < midnight, F.col("first_value"))).alias("first_value"),
        F.max("_listed").alias("_listed"))
    p = p.where("_listed") if users is not None else p.where("active_days > 0")
    f = event_features(F.col("as_of"), n_modules)
    return p.select("user_id", "as_of", *[c for part in f.values() for c in part])

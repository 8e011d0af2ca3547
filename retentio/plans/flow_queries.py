"""Catalog entries for rows in motion: sessions and scores of streams, the
bucketed current table, quarantine of rejected rows."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from retentio.functions.numbers import size_or_zero
from retentio.operators import behavior as bh
from retentio.operators import quality as qa
from retentio.operators import rollup as ru
from retentio.operators.scoring import batch_score
from retentio.plans import oracle as o
from retentio.plans.behavior_queries import DAY, EV, EVENT_SQL, first_day, users
from retentio.plans.catalog import DEFECTIVE_V, FEATURE_COLUMNS, defective, features, query
from retentio.plans.ingest_queries import INCREMENTAL_SQL, land, stream_batches
from retentio.plans.model_checks import trained_model
from retentio.session import collect_garbage, drop_written, scratch_path
from retentio.sources import tables
from retentio.streaming import ingest as si
from retentio.streaming import sessions as ss


# --- sessions --------------------------------------------------------------------------

def closed_sessions(spark, sf):
    """Sessions of the events before ``EV`` by a stream: the events land in
    three parts, a run of the stream after each; the last part brings the
    closing event."""
    events = tables.events(spark, sf).where(F.col("ts") < F.lit(EV)).select("event_id", "ts", "user_id", "event_type")
    first, delay = first_day(events), _dt.timedelta(hours=2)
    landing, out, ckpt = (scratch_path(spark, x) for x in ("events_landing", "sessions", "sessions_ckpt"))
    third = (EV - first) / 3
    cuts = [first, first + third, first + 2 * third, EV]
    for a, b in zip(cuts, cuts[1:]):
        events.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))).write.mode("append").parquet(landing)
        if b == EV:
            ss.close_until(spark, landing, EV, delay)
        ss.run_sessions(spark, landing, out, ckpt, "2 hours")
    return ss.read_sessions(spark, out)


@query("session_stream", """
WITH e AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 1800 THEN 0 ELSE 1 END AS starts
           FROM events WHERE ts < TIMESTAMP '2024-01-31' AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM e)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS actions, count(*) FILTER (WHERE event_type = 'error') AS errors,
       count(*) FILTER (WHERE event_type = 'purchase') AS value_actions FROM s GROUP BY user_id, nth""")
def q_session_stream(spark, sf):
    return closed_sessions(spark, sf).select("user_id", "start", "last", "actions", "errors", "value_actions")


@query("error_rate_streamed", EVENT_SQL["errors"])
def q_error_rate_streamed(spark, sf):
    """Errors per session with the sessions of the stream and the errors of
    the dated rows."""
    path = ru.write_rollup(tables.events(spark, sf), EV - 14 * DAY, EV - DAY, scratch_path(spark, "rollup"))
    errors = ru.read_rollup(spark, path).where("user_id IS NOT NULL").groupBy("user_id").agg(
        F.sum("errors").alias("errors_14d"))
    started = ss.sessions_started(closed_sessions(spark, sf), EV, 14).withColumnRenamed("sessions", "sessions_14d")
    f = users(spark, sf).join(errors, "user_id", "left").join(started, "user_id", "left").fillna(
        0, ["errors_14d", "sessions_14d"])
    return f.select("user_id", *bh.event_features(EV)["errors"])


# --- bucketed current table ---------------------------------------------------------------

@query("bucketed_ingest", INCREMENTAL_SQL)
def q_bucketed_ingest(spark, sf):
    """The batches of ``incremental_ingest``, one run of the stream per
    landing, merged into the bucketed table; then the last batch once more."""
    landing, log, ckpt, table = (scratch_path(spark, x) for x in ("landing", "ingest_log", "ingest_ckpt", "users"))
    batches = stream_batches(spark, sf)
    for i, b in enumerate(batches):
        land(b, f"{landing}/batch={i}")
        si.run_bucketed_ingest(spark, landing + "/*", log, ckpt, table, n_buckets=16)
        collect_garbage(spark)
    drop_written(b)  # the records that the batches are parts of
    si.merge_batch(spark, log, len(batches) - 1, table, n_buckets=16)
    return (si.bucketed_users(spark, table).groupBy("login", "followers", "scraped_at")
            .agg(F.sum(size_or_zero("repositories")).alias("n_repos")))


# --- scoring of arriving rows ------------------------------------------------------

@query("exact_streamed_scores", o.with_base("SELECT login, true AS same_score FROM features_v"))
def q_streamed_scores(spark, sf):
    """Features that arrive in three landings, scored by three runs of the
    stream, against the scores of the whole table: every user once, all
    columns equal."""
    from retentio.streaming.scoring import run_scoring
    model, f = trained_model(spark, sf), features(spark, sf)
    landing, out, ckpt = (scratch_path(spark, x) for x in ("features_landing", "scores", "scores_ckpt"))
    part = F.pmod(F.xxhash64("login"), F.lit(3))
    for k in range(3):
        f.where(part == k).write.mode("append").parquet(landing)
        run_scoring(spark, model, landing, out, ckpt, f.schema)
    a = spark.read.parquet(out)
    b = batch_score(model, f)
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    same = F.lit(True)
    for c in a.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return a.join(b, F.col("login") == F.col("b_login"), "full").select(
        F.coalesce("login", "b_login").alias("login"), same.alias("same_score"))


# --- quarantine ------------------------------------------------------------------------

def _reasons_sql() -> str:
    parts = []
    for c, (lo, hi) in qa.RANGE_RULES.items():
        more = f" WHEN {c} < {lo} THEN '{c}:below'" + (f" WHEN {c} > {hi} THEN '{c}:above'" if hi is not None else "")
        parts.append(f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) THEN '{c}:missing'{more} END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


_REASONS = DEFECTIVE_V + f",\nreasoned AS (SELECT *, {_reasons_sql()} AS reasons FROM defective_v)"


def quarantined(spark, sf):
    return qa.quarantine(defective(spark, sf), scratch_path(spark, "quarantine"))


@query("quarantine_accepted", o.with_base("SELECT * EXCLUDE (reasons) FROM reasoned WHERE len(reasons) = 0", _REASONS))
def q_accepted(spark, sf):
    return quarantined(spark, sf)[0]


@query("quarantine_rejected", o.with_base(
    "SELECT * EXCLUDE (reasons), array_to_string(reasons, ',') AS reasons FROM reasoned WHERE len(reasons) > 0", _REASONS))
def q_rejected(spark, sf):
    text = F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["column"], r["reason"])), ",")
    return quarantined(spark, sf)[1].select("login", *FEATURE_COLUMNS, text.alias("reasons"))


@query("quarantine_report", o.with_base("""
SELECT string_split(r, ':')[1] AS "column", string_split(r, ':')[2] AS reason, count(*) AS n
FROM (SELECT unnest(reasons) AS r FROM reasoned) GROUP BY ALL""", _REASONS))
def q_report(spark, sf):
    return qa.rejection_report(quarantined(spark, sf)[1])

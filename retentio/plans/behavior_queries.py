"""Catalog entries for the behavioural features (events, tickets, billing,
contracts) and the daily snapshot."""

from __future__ import annotations

import datetime as _dt

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from retentio.operators import behavior as bh
from retentio.operators import rollup as ru
from retentio.plans import oracle as o
from retentio.plans.catalog import features, query
from retentio.session import scratch_path, write_once
from retentio.sources import behavior_inputs as bi
from retentio.sources import tables

EV = tables.EVENTS_AS_OF
ORD = tables.ORDERS_AS_OF


def _event_sql(as_of):
    """The five event features at ``as_of``: four for every customer, the
    fifth for users with an event before it."""
    t0 = f"TIMESTAMP '{as_of}'"
    d0 = f"CAST({t0} AS DATE)"

    def since(days):
        return f"ts >= {t0} - INTERVAL {days} DAY"

    seen = f"(SELECT * FROM events WHERE ts < {t0})"
    everyone = f"customer LEFT JOIN {seen} e ON e.user_id = c_custkey"
    breadth = f"count(DISTINCT event_type) FILTER (WHERE {since(30)} AND event_type IN ('click', 'error', 'purchase', 'signup', 'view'))"
    days = f"count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE {since(30)})"
    sessions = f"count(*) FILTER (WHERE {since(14)} AND (prev IS NULL OR epoch(ts) - epoch(prev) > 1800))"
    errors = f"count(*) FILTER (WHERE {since(14)} AND event_type = 'error')"
    value = f"count(*) FILTER (WHERE {since(30)} AND event_type = 'purchase')"
    return {
        "velocity": f"""SELECT user_id, a7 AS actions_7d, a30 AS actions_30d, round(a7 * 4.0 / nullif(a30, 0), 6) AS velocity_ratio,
  a7 * 4.0 / nullif(a30, 0) < 0.5 AS velocity_alert
FROM (SELECT c_custkey AS user_id, count(*) FILTER (WHERE {since(7)}) AS a7, count(*) FILTER (WHERE {since(30)}) AS a30 FROM {everyone} GROUP BY c_custkey)""",
        "breadth": f"""SELECT user_id, m AS modules_used, round(m / 5.0, 6) AS feature_breadth,
  CASE WHEN m / 5.0 <= 0.2 THEN 'low' WHEN m / 5.0 > 0.7 THEN 'high' ELSE 'medium' END AS breadth_band
FROM (SELECT c_custkey AS user_id, {breadth} AS m FROM {everyone} GROUP BY c_custkey)""",
        "intensity": f"""SELECT c_custkey AS user_id, {value} AS value_actions, {days} AS active_days,
  round({value} / nullif({days}, 0), 6) AS core_action_intensity FROM {everyone} GROUP BY c_custkey""",
        "errors": f"""SELECT c_custkey AS user_id, {errors} AS errors_14d, {sessions} AS sessions_14d,
  round({errors} / nullif({sessions}, 0), 6) AS error_rate_severity
FROM customer LEFT JOIN (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {seen}) e
  ON e.user_id = c_custkey GROUP BY c_custkey""",
        "ghosting": f"""SELECT user_id, CAST(s AS INT) AS days_since_signup, CAST(v AS INT) AS days_to_first_value,
  CAST(CASE WHEN v IS NULL THEN s ELSE s - v END AS INT) AS ghosting_rate
FROM (SELECT user_id, {d0} - CAST(min(ts) AS DATE) AS s,
             CAST(min(ts) FILTER (WHERE event_type = 'purchase') AS DATE) - CAST(min(ts) AS DATE) AS v
      FROM {seen} GROUP BY user_id)""",
    }


def _order_sql(as_of, shift=0):
    """Ticket, billing and contract features; order dates moved by ``shift``."""
    t0, d0 = f"TIMESTAMP '{as_of} 00:00:00'", f"DATE '{as_of}'"
    at, closed = f"(o.o_orderdate + INTERVAL {shift} DAY)", f"(l.closed + INTERVAL {shift} DAY)"
    month = f"date_trunc('month', {at})"
    m0 = f"date_trunc('month', {d0})"
    return {
        "friction": f"""WITH t AS (
  SELECT o.o_custkey AS user_id, (epoch({closed}) - epoch({at})) / 3600.0 AS h
  FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS closed FROM lineitem GROUP BY l_orderkey) l
    ON l.l_orderkey = o.o_orderkey
  WHERE {at} < {t0} AND CAST({closed} AS DATE) <= {d0}),
u AS (SELECT user_id, count(*) AS tickets, sum(h) / count(*) AS m FROM t GROUP BY user_id)
SELECT user_id, tickets, round(m, 6) AS mean_hours_to_close,
       round(m / (SELECT sum(h) / count(*) FROM t), 6) AS support_friction FROM u""",
        "momentum": f"""SELECT user_id, current_spend,
  CAST(current_spend - prior / 3 AS DECIMAL(18,2)) AS downgrade_momentum FROM (
  SELECT o_custkey AS user_id,
    CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE {month} = {m0}), 0) AS DECIMAL(18,2)) AS current_spend,
    coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE {month} < {m0} AND {month} >= {m0} - INTERVAL 3 MONTH), 0) AS prior
  FROM orders o WHERE {month} <= {m0} GROUP BY o_custkey)""",
        "renewal": f"""SELECT user_id, CAST(end_date - {d0} AS INT) AS days_to_renewal, end_date - {d0} < 30 AS renewal_alert
FROM (SELECT o_custkey AS user_id, CAST(max({at}) AS DATE) + 365 AS end_date FROM orders o
      WHERE CAST({at} AS DATE) <= {d0} GROUP BY o_custkey)""",
    }


EVENT_SQL = _event_sql("2024-01-31 00:00:00")
ORDER_SQL = _order_sql("2001-08-01")


def users(spark, sf):
    """The users table: every customer, silent ones too."""
    return tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))


@query("velocity_ratio", EVENT_SQL["velocity"])
def q_velocity(spark, sf):
    return bh.velocity_ratio(tables.events(spark, sf), EV, users=users(spark, sf))


@query("feature_breadth", EVENT_SQL["breadth"])
def q_breadth(spark, sf):
    return bh.feature_breadth(tables.events(spark, sf), EV, users=users(spark, sf))


@query("feature_breadth_sketch", EVENT_SQL["breadth"])
def q_breadth_sketch(spark, sf):
    """Modules counted by sketches that are stored per day and merged; so few
    modules are counted exactly."""
    path = ru.write_rollup(tables.events(spark, sf), EV - 30 * DAY, EV - DAY, scratch_path(spark, "rollup"))
    f = ru.event_features_at(ru.read_rollup(spark, path), [EV], users=users(spark, sf), approximate=True)
    return f.select("user_id", "modules_used", "feature_breadth", "breadth_band")


@query("core_action_intensity", EVENT_SQL["intensity"])
def q_intensity(spark, sf):
    return bh.core_action_intensity(tables.events(spark, sf), EV, users=users(spark, sf))


@query("error_rate_severity", EVENT_SQL["errors"])
def q_errors(spark, sf):
    return bh.error_rate_severity(tables.events(spark, sf), EV, users=users(spark, sf))


@query("ghosting_rate", EVENT_SQL["ghosting"])
def q_ghost(spark, sf):
    return bh.ghosting_rate(tables.events(spark, sf), EV)


@query("support_friction", ORDER_SQL["friction"])
def q_friction(spark, sf):
    return bh.support_friction(bi.tickets(spark, sf), ORD)


@query("downgrade_momentum", ORDER_SQL["momentum"])
def q_momentum(spark, sf):
    return bh.downgrade_momentum(bi.billing(spark, sf), ORD)


@query("renewal_danger_zone", ORDER_SQL["renewal"])
def q_renewal(spark, sf):
    return bh.renewal_danger_zone(bi.contracts(spark, sf), ORD)


DAY = _dt.timedelta(days=1)
# Two days of the dated feature table.
SNAPSHOTS = (EV - 16 * DAY, EV)
# The feature dates of a whole month.
BACKFILL = tuple(EV - k * DAY for k in range(29, -1, -1))
_EVENT_COLS = ["actions_7d", "actions_30d", "velocity_ratio", "velocity_alert", "modules_used",
               "feature_breadth", "breadth_band", "value_actions", "active_days", "core_action_intensity",
               "errors_14d", "sessions_14d", "error_rate_severity", "days_since_signup",
               "days_to_first_value", "ghosting_rate"]


def first_day(events) -> _dt.datetime:
    """The day of the first event (midnight): dated rows reach back to it, so
    that first events are known."""
    first = events.where(F.col("ts") < F.lit(EV)).agg(F.min("ts")).first()[0]
    return _dt.datetime.combine(first.date(), _dt.time()) if first else EV - 30 * DAY


def rolled_up(spark, sf):
    """The dated rows of all event days, written in three runs: the second
    half of the days, the first half, and one day again. Days are independent,
    so the order does not matter. Returns the path and the first half's last
    day."""
    events, path = tables.events(spark, sf), scratch_path(spark, "rollup")
    first, last = first_day(events), EV - DAY
    half = first + (last - first).days // 2 * DAY
    ru.write_rollup(events, half + DAY, last, path)
    ru.write_rollup(events, first, half, path)
    ru.write_rollup(events, half, half, path)
    return path, half


@query("event_rollup", """
WITH s AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, user_id, count(*) AS actions,
       CAST(sum(DISTINCT CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8
                         WHEN 'view' THEN 16 ELSE 0 END) AS BIGINT) AS modules,
       count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view')) AS kinds,
       count(*) FILTER (WHERE event_type = 'purchase') AS value_actions,
       count(*) FILTER (WHERE event_type = 'error') AS errors,
       count(*) FILTER (WHERE prev IS NULL OR epoch(ts) - epoch(prev) > 1800) AS sessions,
       min(ts) AS first_event, min(ts) FILTER (WHERE event_type = 'purchase') AS first_value
FROM s GROUP BY CAST(ts AS DATE), user_id""")
def q_event_rollup(spark, sf):
    """The dated table: every user's day, sessions across midnight counted
    where they start."""
    r = ru.read_rollup(spark, rolled_up(spark, sf)[0]).where("user_id IS NOT NULL")
    return r.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id", "actions", "modules",
                    F.hll_sketch_estimate("modules_sketch").alias("kinds"), "value_actions", "errors", "sessions",
                    "first_event", "first_value")


def _backfill_sql():
    days = []
    for as_of in BACKFILL:
        sql = _event_sql(as_of)
        ctes = ",\n".join(f"{k} AS ({q})" for k, q in sql.items())
        days.append(f"""SELECT * FROM (WITH {ctes}
SELECT user_id, '{as_of.date()}' AS as_of, * EXCLUDE (user_id) FROM velocity JOIN breadth USING (user_id)
JOIN intensity USING (user_id) JOIN errors USING (user_id) LEFT JOIN ghosting USING (user_id))""")
    return "\nUNION ALL\n".join(days)


@query("feature_backfill", _backfill_sql())
def q_backfill(spark, sf):
    """The event features of 30 dates from one scan of the dated rows, written
    into the dated feature table; one date is computed and written again."""
    path, half = rolled_up(spark, sf)
    firsts = ru.merge_firsts(ru.read_rollup(spark, path, last_day=half))
    firsts = write_once(ru.merge_firsts(ru.read_rollup(spark, path, half + DAY), firsts), "firsts")
    out = scratch_path(spark, "feature_history")
    for dates in (BACKFILL, BACKFILL[9:10]):
        f = ru.event_features_at(ru.read_rollup(spark, path), dates, users(spark, sf), firsts)
        bh.write_snapshot(f, None, out)
    back = spark.read.parquet(out)
    return back.select("user_id", F.date_format("snapshot_date", "yyyy-MM-dd").alias("as_of"), *_EVENT_COLS)


def snapshot_parts(spark, sf, days):
    """All sources on the events' clock, all features of the ``days``: event
    features by one pass over the dated rows, the others per day."""
    shift, path = bi.TO_EVENT_CLOCK, scratch_path(spark, "rollup")
    events = tables.events(spark, sf)
    ru.write_rollup(events, first_day(events), max(days) - DAY, path)
    rows = ru.read_rollup(spark, path)
    firsts = ru.merge_firsts(rows)
    parts = [ru.event_features_at(rows, days, users(spark, sf), firsts)]
    for as_of in days:
        day = as_of.date()
        parts += [p.withColumn("as_of", F.lit(day)) for p in (
            bh.support_friction(bi.tickets(spark, sf, shift), day),
            bh.downgrade_momentum(bi.billing(spark, sf, shift), day),
            bh.renewal_danger_zone(bi.contracts(spark, sf, day, shift=shift), day))]
    return parts


_SNAP_COLS = [*_EVENT_COLS, "tickets", "mean_hours_to_close", "support_friction", "current_spend",
              "downgrade_momentum", "days_to_renewal", "renewal_alert"]


def _snapshot_sql():
    days = []
    for as_of in SNAPSHOTS:
        sql = [*_event_sql(as_of).values(), *_order_sql(as_of.date(), bi.TO_EVENT_CLOCK).values()]
        ctes = ",\n".join(f"p{i} AS ({q})" for i, q in enumerate(sql))
        unions = "\nUNION ALL BY NAME\n".join(f"SELECT * FROM p{i}" for i in range(len(sql)))
        aggs = ", ".join(f"max({c}) AS {c}" for c in _SNAP_COLS)
        days.append(f"""SELECT * FROM (WITH {ctes},
u AS ({unions})
SELECT user_id, {aggs}, '{as_of.date()}' AS snapshot_date FROM u GROUP BY user_id)""")
    return "\nUNION ALL\n".join(days)


@query("user_features_snapshot", _snapshot_sql())
def q_snapshot(spark, sf):
    """Two days written into one dated table, the first of them twice (from
    the same parts: a re-run replaces its day only)."""
    path = scratch_path(spark, "user_features_snapshot")
    snap = write_once(bh.user_features_snapshot(snapshot_parts(spark, sf, SNAPSHOTS)), "snapshot")
    bh.write_snapshot(snap, None, path)
    bh.write_snapshot(snap.where(F.col("as_of") == F.lit(SNAPSHOTS[0].date())), None, path)
    back = spark.read.parquet(path)
    return back.select("user_id", *_SNAP_COLS,
                       F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"))


_Z_COLS = ["account_age_days", "repos_per_year", "followers_following_ratio", "avg_stars_per_repo",
           "avg_forks_per_repo", "repo_activity_density", "repository_maintenance_ratio"]


@query("scaled_features", o.with_base("SELECT login, " + ", ".join(
    f"round((coalesce({c}, 0.0) - avg(coalesce({c}, 0.0)) OVER ()) / stddev_samp(coalesce({c}, 0.0)) OVER (), 6) AS {c}_z"
    for c in _Z_COLS) + " FROM features_v"))
def q_scaled(spark, sf):
    return bh.scaled_features(features(spark, sf), _Z_COLS, key="login")


_SCALED = ["actions_7d", "actions_30d", "value_actions", "active_days", "errors_14d", "sessions_14d",
           "velocity_ratio", "core_action_intensity"]


def _scaled_next_sql():
    def day(as_of):
        sql = _event_sql(as_of)
        ctes = ",\n".join(f"{k} AS ({q})" for k, q in sql.items() if k != "ghosting")
        return f"""(WITH {ctes} SELECT * FROM velocity JOIN intensity USING (user_id) JOIN errors USING (user_id))"""
    moments = ", ".join(f"avg(coalesce({c}, 0.0)) AS m_{c}, stddev_samp(coalesce({c}, 0.0)) AS s_{c}" for c in _SCALED)
    z = ", ".join(f"CASE WHEN s_{c} > 0 THEN round((coalesce({c}, 0.0) - m_{c}) / s_{c}, 6) ELSE 0.0 END AS {c}_z" for c in _SCALED)
    return f"SELECT user_id, {z} FROM {day(SNAPSHOTS[1])} b, (SELECT {moments} FROM {day(SNAPSHOTS[0])})"


@query("scaled_next_day", _scaled_next_sql())
def q_scaled_next(spark, sf):
    """A scaler fitted on one day's features, saved, loaded and applied to a
    later day: its z-scores use the first day's moments."""
    path, _ = rolled_up(spark, sf)
    f = ru.event_features_at(ru.read_rollup(spark, path), SNAPSHOTS, users(spark, sf))
    f = write_once(f.select("user_id", "as_of", *_SCALED), "two-days")
    first, later = (f.where(F.col("as_of") == F.lit(d.date())) for d in SNAPSHOTS)
    where = scratch_path(spark, "scaler")
    bh.fit_scaler(first, _SCALED).write().overwrite().save(where)
    return bh.apply_scaler(PipelineModel.load(where), later)

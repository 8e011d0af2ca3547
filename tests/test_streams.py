"""Streams: sessions, scores, the bucketed current table; quarantine."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from retentio.operators import quality as qa
from retentio.streaming import ingest as si
from retentio.streaming import sessions as ss

T0 = dt.datetime(2024, 1, 1, 9)


def minutes(m):
    return T0 + dt.timedelta(minutes=m)


def land(spark, path, rows):
    spark.createDataFrame([(i, t, u, k) for i, (t, u, k) in enumerate(rows)], ss.EVENT).coalesce(1).write.mode("append").parquet(path)


def closed(spark, path):
    return sorted((r.user_id, r.start, r.last, r.actions, r.errors) for r in ss.read_sessions(spark, path).collect())


@pytest.fixture
def paths(tmp_path):
    return [str(tmp_path / x) for x in ("landing", "out", "ckpt")]


def test_a_session_across_two_runs_is_one(spark, paths):
    landing, out, ckpt = paths
    land(spark, landing, [(minutes(0), 1, "view"), (minutes(30), 1, "error"), (minutes(61), 1, "view")])
    ss.run_sessions(spark, landing, out, ckpt, "10 minutes")
    land(spark, landing, [(minutes(91), 1, "error"), (minutes(300), 1, "view"), (minutes(300), None, "view")])
    ss.run_sessions(spark, landing, out, ckpt, "10 minutes")
    # a gap of exactly 30 minutes joins, a longer one parts; the last session is still open
    want = [(1, minutes(0), minutes(30), 2, 1), (1, minutes(61), minutes(91), 2, 1)]
    assert closed(spark, out) == want
    ss.close_until(spark, landing, minutes(301), dt.timedelta(minutes=10))
    ss.run_sessions(spark, landing, out, ckpt, "10 minutes")
    assert closed(spark, out) == [*want, (1, minutes(300), minutes(300), 1, 0)]
    ss.run_sessions(spark, landing, out, ckpt, "10 minutes")  # nothing new
    assert len(closed(spark, out)) == 3


def test_events_later_than_the_delay_are_dropped_nearer_ones_count(spark, paths):
    landing, out, ckpt = paths
    land(spark, landing, [(minutes(0), 1, "view"), (minutes(200), 2, "view")])
    ss.run_sessions(spark, landing, out, ckpt, "60 minutes")
    land(spark, landing, [(minutes(10), 1, "view"), (minutes(180), 2, "error")])  # behind and within the delay
    ss.close_until(spark, landing, minutes(240), dt.timedelta(minutes=60))
    ss.run_sessions(spark, landing, out, ckpt, "60 minutes")
    assert closed(spark, out) == [(1, minutes(0), minutes(0), 1, 0), (2, minutes(180), minutes(200), 2, 1)]


def test_sessions_started_in_a_frame(spark, paths):
    landing, out, ckpt = paths
    land(spark, landing, [(minutes(0), 1, "view"), (minutes(1500), 1, "view"), (minutes(1600), 1, "view"), (minutes(1500), 2, "view")])
    ss.close_until(spark, landing, minutes(2000), dt.timedelta(hours=2))
    ss.run_sessions(spark, landing, out, ckpt)
    got = ss.sessions_started(ss.read_sessions(spark, out), minutes(1600), 1)
    assert {(r.user_id, r.sessions) for r in got.collect()} == {(1, 1), (2, 1)}


# --- bucketed current table ------------------------------------------------------------

LOG = "login string, followers string, part int, scraped_at string, batch_id int, _file string, _block long, _row long"


def log_rows(seed, n_batches=4):
    rng = random.Random(seed)
    rows = []
    for b in range(n_batches):
        for i in range(25):
            name = rng.choice(["Ann", "bob", "CID", "dan", "eve", "Fay"]) + str(rng.randrange(6))
            name = rng.choice([str.lower, str.upper, str])(name)
            for part in range(rng.choice([1, 1, 2])):
                rows.append((name, f"{b}-{i}", part, rng.choice([None, "2024-01-01", "2024-01-02", "2024-01-03"]), b, f"f{i % 3}", 0, i))
    return rows + [("", "x", 0, "2024-01-09", 1, "f", 0, 99), (None, "x", 0, "2024-01-09", 2, "f", 0, 99)]


def content(df):
    return sorted(tuple(r) for r in df.select("login", "followers", "part", "scraped_at").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_buckets_equal_the_reduced_log(spark, tmp_path, seed):
    rows, log, table = log_rows(seed), str(tmp_path / "log"), str(tmp_path / "table")
    for b in range(4):
        spark.createDataFrame([r for r in rows if r[4] == b], LOG).repartition(3).write.mode("append").partitionBy("batch_id").parquet(log)
        si.merge_batch(spark, log, b, table, n_buckets=8)
        assert content(si.bucketed_users(spark, table)) == content(si.current_users(spark, log))
    before = content(si.bucketed_users(spark, table))
    si.merge_batch(spark, log, 3, table, n_buckets=8)
    assert content(si.bucketed_users(spark, table)) == before


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    log, table = str(tmp_path / "log"), tmp_path / "table"
    first = [(f"user{i}", "1", 0, "2024-01-01", 0, "f", 0, i) for i in range(200)]
    spark.createDataFrame(first, LOG).write.partitionBy("batch_id").parquet(log)
    si.merge_batch(spark, log, 0, str(table), n_buckets=16)

    def files():
        return {p.name: {f.name for f in p.glob("part-*")} for p in table.glob("bucket=*")}

    before = files()
    assert len(before) == 16
    spark.createDataFrame([("USER7", "2", 0, "2024-01-02", 1, "f", 0, 0)], LOG).write.mode("append").partitionBy("batch_id").parquet(log)
    si.merge_batch(spark, log, 1, str(table), n_buckets=16)
    after = files()
    bucket = spark.createDataFrame([("user7",)], "login string").select(si.bucket_of("login", 16)).first()[0]
    assert {b for b in after if after[b] != before[b]} == {f"bucket={bucket}"}
    got = si.bucketed_users(spark, str(table))
    assert got.count() == 200 and got.where("login = 'USER7' AND followers = '2'").count() == 1
    # a batch without a usable login changes nothing
    spark.createDataFrame([("", "2", 0, "2024-01-02", 2, "f", 0, 0)], LOG).write.mode("append").partitionBy("batch_id").parquet(log)
    si.merge_batch(spark, log, 2, str(table), n_buckets=16)
    assert files() == after


# --- quarantine ------------------------------------------------------------------------

def test_every_row_is_accepted_or_rejected_with_its_reasons(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.5, 3.0), (2, 1.5, -1.0), (3, None, nan), (4, -0.1, inf), (5, 1.0, 0.0), (6, nan, 2.0)]
    df = spark.createDataFrame(rows, "id int, share double, age double").withColumn("text", F.lit("abc"))
    rules = {"share": (0.0, 1.0), "age": (0.0, None)}
    ok, bad = qa.quarantine(df, str(tmp_path / "q"), rules)
    assert ok.columns == df.columns and {r.id for r in ok.collect()} == {1, 5}
    got = {r.id: [tuple(x) for x in r.reasons] for r in bad.collect()}
    assert got == {2: [("share", "above"), ("age", "below")], 3: [("share", "missing"), ("age", "missing")],
                   4: [("share", "below")], 6: [("share", "missing")]}
    report = {(r.column, r.reason): r.n for r in qa.rejection_report(bad).collect()}
    assert report == {("share", "above"): 1, ("age", "below"): 1, ("share", "missing"): 2, ("age", "missing"): 1, ("share", "below"): 1}
    words, other = qa.quarantine(df, str(tmp_path / "w"), {"text": (0.0, None)})
    assert words.count() == 0 and other.count() == 6
    none_ok, none_bad = qa.quarantine(df.where("id < 0"), str(tmp_path / "e"), rules)
    assert none_ok.count() == none_bad.count() == 0

"""Dated aggregates and the features merged from them, against the features
computed from raw events and against loops over the events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from retentio.operators import behavior as bh
from retentio.operators import rollup as ru

DAY = dt.timedelta(days=1)
END = dt.datetime(2024, 3, 1)
KINDS = ["click", "error", "purchase", "signup", "view", "other"]


def random_events(seed, n=1500, days=50):
    """Bursts around midnight and exact gaps of 30 minutes among them."""
    rng = random.Random(seed)
    rows, t = [], END - days * DAY
    for _ in range(n):
        t = END - days * DAY + dt.timedelta(seconds=rng.randrange(days * 86400))
        if rng.random() < 0.4:
            t = t.replace(hour=rng.choice([23, 0]), minute=rng.choice([0, 29, 30, 31, 59]), second=0)
        user = rng.choice([1, 1, 1, 2, 3, 4, 5, None])
        rows.append((t, user, rng.choice(KINDS)))
        if rng.random() < 0.5:
            rows.append((t + dt.timedelta(seconds=rng.choice([1799, 1800, 1801, 0])), user, rng.choice(KINDS)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "event_id long, ts timestamp_ntz, user_id long, event_type string")


def by_hand(rows, first, last):
    out = {}
    for u in {r[1] for r in rows} - {None}:
        prev = None
        for t, _, k in sorted((r for r in rows if r[1] == u), key=lambda r: r[0]):
            d = out.setdefault((t.date(), u), [0, set(), 0, 0, 0, t, None])
            d[0] += 1
            d[1] |= {k} - {"other"}
            d[2] += k == "purchase"
            d[3] += k == "error"
            d[4] += prev is None or t - prev > dt.timedelta(minutes=30)
            d[6] = t if k == "purchase" and d[6] is None else d[6]
            prev = t
    return {key: (d[0], len(d[1]), *d[2:]) for key, d in out.items() if first <= key[0] <= last}


@pytest.mark.parametrize("seed", [1, 2])
def test_dated_rows_match_a_loop_over_the_events(spark, seed):
    rows = random_events(seed)
    first, last = (END - 20 * DAY).date(), (END - 3 * DAY).date()
    got = {(r.day, r.user_id): (r.actions, bin(r.modules).count("1"), r.value_actions, r.errors, r.sessions, r.first_event, r.first_value)
           for r in ru.daily_aggregates(frame(spark, rows), first, last).collect()}
    assert got == by_hand(rows, first, last)


def test_merged_features_equal_those_of_raw_events(spark, tmp_path):
    rows = random_events(3)
    events, path = frame(spark, rows), str(tmp_path / "rollup")
    ru.write_rollup(events, END - 20 * DAY, END - DAY, path)
    ru.write_rollup(events, END - 60 * DAY, END - 21 * DAY, path)
    users = spark.createDataFrame([(u,) for u in (1, 2, 3, 4, 5, 77)], "user_id long")
    dates = [END - k * DAY for k in (0, 1, 7, 19)]
    firsts = ru.merge_firsts(ru.read_rollup(spark, path))
    got = {(r.user_id, r.as_of): r.asDict() for r in ru.event_features_at(ru.read_rollup(spark, path), dates, users, firsts).collect()}
    assert len(got) == 6 * 4
    known = events.where("user_id IS NOT NULL")
    for d in dates:
        for f in (bh.velocity_ratio, bh.feature_breadth, bh.core_action_intensity, bh.error_rate_severity):
            for r in f(known, d, users=users).collect():
                mine = got[(r.user_id, d.date())]
                assert {k: mine[k] for k in r.asDict()} == r.asDict(), (f.__name__, d, r.user_id)
        for r in bh.ghosting_rate(known, d).collect():
            mine = got[(r.user_id, d.date())]
            assert {k: mine[k] for k in r.asDict()} == r.asDict()
    sketch = ru.event_features_at(ru.read_rollup(spark, path), dates, users, approximate=True).collect()
    assert all(r.modules_used == got[(r.user_id, r.as_of)]["modules_used"] for r in sketch)
    active = ru.event_features_at(ru.read_rollup(spark, path), dates).collect()
    assert {(r.user_id, r.as_of) for r in active} == {k for k, v in got.items() if v["active_days"]}


def test_a_day_computed_again_replaces_its_partition_only(spark, tmp_path):
    rows = random_events(4, n=300, days=10)
    path = tmp_path / "rollup"
    ru.write_rollup(frame(spark, rows), END - 10 * DAY, END - DAY, str(path))
    day = (END - 4 * DAY).date()

    def files():
        return {p.parent.name: {x.name for x in p.parent.glob("part-*")} for p in path.glob("day=*/part-*")}

    before = files()
    assert len(before) == 10
    late = [(dt.datetime.combine(day, dt.time(12)), 9, "purchase")]
    ru.write_rollup(frame(spark, rows + late), day, day, str(path))
    after = files()
    assert {d for d in after if after[d] != before[d]} == {f"day={day}"}
    assert ru.read_rollup(spark, str(path)).where("user_id = 9").count() == 1
    # a day that lost its events is empty afterwards, not stale
    ru.write_rollup(frame(spark, [r for r in rows if r[0].date() != day]), day, day, str(path))
    assert ru.read_rollup(spark, str(path), day, day).where("user_id IS NOT NULL").count() == 0
    assert ru.missing_days(spark, str(path), END - 10 * DAY, END - DAY) == []


def test_days_never_computed_are_told_from_silent_ones(spark, tmp_path):
    path = str(tmp_path / "rollup")
    assert len(ru.missing_days(spark, path, END - 3 * DAY, END - DAY)) == 3
    empty = frame(spark, [(END - 90 * DAY, 1, "view")])
    ru.write_rollup(empty, END - 3 * DAY, END - 2 * DAY, path)
    assert ru.missing_days(spark, path, END - 3 * DAY, END - DAY) == [(END - DAY).date()]


def test_firsts_merge_in_any_order_and_again(spark, tmp_path):
    rows = random_events(5, n=400, days=12)
    path = str(tmp_path / "rollup")
    ru.write_rollup(frame(spark, rows), END - 12 * DAY, END - DAY, path)
    whole = sorted(ru.merge_firsts(ru.read_rollup(spark, path)).collect())
    late = ru.merge_firsts(ru.read_rollup(spark, path, END - 5 * DAY))
    again = ru.merge_firsts(ru.read_rollup(spark, path, END - 7 * DAY), late)
    assert sorted(ru.merge_firsts(ru.read_rollup(spark, path, last_day=END - 6 * DAY), again).collect()) == whole


def test_reading_many_dates_scans_the_rows_once_and_prunes_days(spark, tmp_path):
    path = str(tmp_path / "rollup")
    ru.write_rollup(frame(spark, random_events(6, n=100, days=50)), END - 50 * DAY, END - DAY, path)
    f = ru.event_features_at(ru.read_rollup(spark, path), [END - k * DAY for k in range(15)])
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == plan.count("Exchange hashpartitioning") == 1
    assert "PartitionFilters: [isnotnull(day" in plan


def test_half_days_are_refused(spark):
    with pytest.raises(ValueError, match="whole days"):
        ru.event_features_at(spark.range(0), [dt.datetime(2024, 1, 1, 12)])
    with pytest.raises(ValueError, match="divide a day"):
        ru.daily_aggregates(frame(spark, [(END, 1, "view")]), END, END, gap_minutes=7)


def test_events_without_user_are_not_counted(spark):
    e = frame(spark, [(END, None, "view"), (END, 1, "view")])
    assert [r.user_id for r in ru.daily_aggregates(e, END, END).collect()] == [1]
    assert ru.daily_aggregates(e.where(F.lit(False)), END, END).count() == 0

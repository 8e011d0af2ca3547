"""parse_date on text rendered from known instants: the accepted layouts give
the UTC day of the instant, everything else gives NULL."""

import datetime as dt
import random

from pyspark.sql import functions as F

from retentio.functions.dates import parse_date

EPOCH = dt.datetime(1970, 1, 1)
JUNK = [None, "", "  ", "garbage", "2024/01/02", "02024-01-02", "2024-02-30", "2024-13-01", "2024-01-02T25:00:00", "T10:00:00"]


def cases(rng, n):
    """(text, day): a moment in UTC, shown at an offset in some layout."""
    for _ in range(n):
        seconds = rng.randrange(0, 1_900_000_000)
        utc_day = (EPOCH + dt.timedelta(seconds=seconds)).date()
        minutes = rng.choice([0, 30, 60, 330, 840]) * rng.choice([1, -1])
        shown = EPOCH + dt.timedelta(seconds=seconds, minutes=minutes)
        day, clock = shown.strftime("%Y-%m-%d"), shown.strftime("%H:%M:%S")
        if rng.random() < 0.3:  # fields without leading zeros are accepted
            day = f"{shown.year}-{shown.month}-{shown.day}"
        sign, (h, m) = "+" if minutes >= 0 else "-", divmod(abs(minutes), 60)
        offset = rng.choice([f"{sign}{h:02d}:{m:02d}", f"{sign}{h:02d}{m:02d}"] + (["Z"] if minutes == 0 else []))
        kind = rng.choice(["date", "local", "zoned", "zoned", "spaced", "space without zone", "fraction", "cut"])
        if kind == "date":
            yield day, shown.date()
        elif kind == "local":  # taken as UTC
            yield f"{day}T{clock}", shown.date()
        elif kind == "zoned":
            yield f"{day}{rng.choice('T ')}{clock}{offset}", utc_day
        elif kind == "spaced":
            yield f"  {day}T{clock}{offset} ", utc_day
        elif kind == "space without zone":
            yield f"{day} {clock}", None
        elif kind == "fraction":
            yield f"{day}T{clock}.{rng.randrange(1000):03d}{offset}", None
        else:
            yield f"{day}T{clock[:rng.randint(0, 5)]}"[:-1] + ":", None


def test_parse_date_gives_the_utc_day(spark):
    known = list(cases(random.Random(20241202), 3000)) + [(j, None) for j in JUNK]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(known)], "i int, s string")
    got = {r.i: r.d for r in df.select("i", parse_date(F.col("s")).alias("d")).collect()}
    bad = [(s, day, got[i]) for i, (s, day) in enumerate(known) if day != got[i]]
    assert not bad, bad[:10]

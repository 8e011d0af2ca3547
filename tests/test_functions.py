import datetime as dt

from pyspark.sql import functions as F

from retentio.functions.dates import DATE_PATTERNS, PLAIN, TIMESTAMP_PATTERNS, days_between, parse_date, parse_timestamp
from retentio.operators.labels import churn_label

D = dt.date


def test_parse_date_accepts_only_the_four_layouts(spark):
    cases = [
        ("2024-01-02T03:04:05Z", D(2024, 1, 2)),
        (" 2024-01-02 03:04:05+02:00 ", D(2024, 1, 2)),
        ("2024-01-02T03:04:05", D(2024, 1, 2)),
        ("2024-01-02", D(2024, 1, 2)),
        ("2024-1-2", D(2024, 1, 2)),
        ("2024-01-01T23:30:00-03:00", D(2024, 1, 2)),
        ("2024-01-01T23:30:00-0300", D(2024, 1, 2)),
        ("2024-01-02T03:04:05.123Z", None),
        ("2024-01-02 03:04:05", None),
        ("", None),
        ("garbage", None),
        ("2024-02-30", None),
        ("02024-01-02", None),
        (None, None),
    ]
    df = spark.createDataFrame(cases, "s string, expected date")
    got = df.select("s", "expected", parse_date(F.col("s")).alias("got")).collect()
    bad = [(r.s, r.expected, r.got) for r in got if r.expected != r.got]
    assert not bad


def test_days_between_clamps_and_propagates_null(spark):
    df = spark.createDataFrame(
        [(D(2024, 1, 1), D(2024, 1, 11), 10), (D(2024, 1, 11), D(2024, 1, 1), 0),
         (None, D(2024, 1, 1), None)], "a date, b date, expected int")
    for r in df.select("expected", days_between(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.expected == r.got


def test_churn_label_rules(spark):
    rows = [("NULL", None), ("NaN", "NaN"), ("inf", "Infinity"), ("-inf", "-Infinity"),
            ("neg", "-1"), ("text", "abc"), ("zero", "0"), ("at", "180"), ("above_half", "180.5"),
            ("above", "181")]
    df = spark.createDataFrame(rows, "k string, v string")
    got = {r.k: r.c for r in df.select("k", churn_label(F.col("v"), df.schema["v"].dataType).alias("c"))
           .collect()}
    assert got == {"NULL": None, "NaN": None, "inf": None, "-inf": None, "neg": None, "text": None,
                   "zero": 0, "at": 0, "above_half": 1, "above": 1}
    num = spark.createDataFrame([(float("nan"),), (180.0,), (181.0,)], "v double")
    assert [r.c for r in num.select(churn_label(F.col("v"), num.schema["v"].dataType).alias("c"))
            .collect()] == [None, 0, 1]


def test_plain_layouts_are_cast_to_what_the_patterns_read(spark):
    days = [f"{y}-{m}-{d}" for y in ("1000", "1582", "1900", "2023", "2024", "9999", "0999", "0000")
            for m in ("00", "02", "10", "12", "13") for d in ("00", "01", "05", "14", "28", "29", "30", "31", "32")]
    times = ["", "T00:00:00Z", "T23:59:59Z", "T24:00:00Z", "T12:60:00Z", "T12:00:60Z", "T12:00:00Z\n", "\n", "T12:00:00", "T1:2:3Z"]
    df = spark.createDataFrame([(d + t,) for d in days for t in times], "s string")

    def by_patterns(zone, patterns):
        cleaned = F.regexp_replace(F.trim("s"), zone, "+00:00")
        return F.coalesce(*[F.try_to_timestamp(cleaned, F.lit(p)) for p in patterns])

    date, at = parse_date(F.col("s")), parse_timestamp(F.col("s"))
    wrong = df.where(~date.eqNullSafe(F.to_date(by_patterns("Z", DATE_PATTERNS)))
                     | ~at.eqNullSafe(by_patterns("Z$", TIMESTAMP_PATTERNS)))
    assert wrong.collect() == []
    assert df.where(F.col("s").rlike(PLAIN) & date.isNotNull()).count() > 100

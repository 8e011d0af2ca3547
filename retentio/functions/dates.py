"""Date parsing and day arithmetic with the exact acceptance rules of the
feature layer: only four layouts are valid, offsets are converted to UTC
before the date is taken, and anything else is NULL."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted layouts. An ISO offset may be written +hh:mm or
# +hhmm, a trailing Z means +00:00; the zone-less date-time is read as UTC.
DATE_PATTERNS = (
    "yyyy-M-d'T'H:m:sXXX",
    "yyyy-M-d'T'H:m:sXX",
    "yyyy-M-d H:m:sXXX",
    "yyyy-M-d H:m:sXX",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d",
)

# Fixed value: the layout that collectors write. A cast reads it to the same
# instant as the patterns do, without a formatter per value.
PLAIN = r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}Z)?\z"


def _first_layout(s: Column, cleaned: Column, patterns: tuple[str, ...]) -> Column:
    """Plain text by cast, all other text by the first pattern that reads it."""
    cleaned = F.when(cleaned != "", cleaned)
    return F.coalesce(F.when(s.rlike(PLAIN), s.try_cast("timestamp")),
                      *[F.try_to_timestamp(cleaned, F.lit(p)) for p in patterns])


def parse_date(s: Column) -> Column:
    """STRING → DATE (UTC). Blank, unparsable or out-of-range text → NULL."""
    return F.to_date(_first_layout(s, F.regexp_replace(F.trim(s), "Z", "+00:00"), DATE_PATTERNS))


def to_utc_date(c: Column, dtype: T.DataType) -> Column:
    """Any date-like column → DATE, choosing the conversion from its type."""
    if isinstance(dtype, T.StringType):
        return parse_date(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    if isinstance(dtype, T.DateType):
        return c
    return F.lit(None).cast("date")


def as_of_date(as_of) -> Column:
    """Literal DATE for a reference day (``None`` → today's date)."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return F.to_date(as_of)
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.date()
    if isinstance(as_of, _dt.date):
        return F.lit(as_of)
    return F.to_date(F.lit(str(as_of)))


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days from ``earlier`` to ``later``; NULL if either is NULL,
    negative gaps clamp to 0."""
    return F.when(earlier.isNotNull() & later.isNotNull(),
                  F.greatest(F.datediff(later, earlier), F.lit(0)))


# ISO-8601 layouts accepted for instants (fractions allowed).
TIMESTAMP_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd",
)


def parse_timestamp(s: Column) -> Column:
    """ISO-8601 text → TIMESTAMP; a trailing Z is UTC, zone-less text is read
    as UTC; unparsable → NULL."""
    return _first_layout(s, F.regexp_replace(F.trim(s), "Z$", "+00:00"), TIMESTAMP_PATTERNS)


def to_timestamp_any(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return parse_timestamp(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    return F.lit(None).cast("timestamp")

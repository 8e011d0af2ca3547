"""Numeric coercion and guarded arithmetic.

Raw profile counters arrive as text: NULL or '' means 0, text that does not
cast marks the whole record as unusable (see ``bad_number``). Ratios with a
zero denominator are 0.0. NaN is mapped to NULL on entry because Spark orders
NaN above every number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_or_zero(c: Column, dtype: T.DataType, to: str = "long") -> Column:
    """``x or 0`` semantics: NULL and '' become 0, text is cast with ``try_cast``."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.nullif(c, F.lit("")).try_cast(to), F.lit(0).cast(to))
    return F.coalesce(c.cast(to), F.lit(0).cast(to))


def bad_number(c: Column, dtype: T.DataType, to: str = "long") -> Column:
    """True when a present, non-empty value does not cast to ``to``."""
    if isinstance(dtype, T.StringType):
        return c.isNotNull() & (c != "") & c.try_cast(to).isNull()
    if isinstance(dtype, (T.NumericType, T.BooleanType)) or isinstance(dtype, T.NullType):
        return F.lit(False)
    return c.isNotNull() & c.cast("string").try_cast(to).isNull()


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def finite_or_null(c: Column) -> Column:
    """NaN and ±inf → NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def round4(c: Column) -> Column:
    return F.round(c, 4)


def div_or_zero(num: Column, den: Column, digits: int = 4) -> Column:
    """``round(num/den, digits)``, 0.0 when ``den`` is 0 (``when`` short-circuits
    so ANSI division never sees a zero)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(
        F.round(num.cast("double") / den.cast("double"), digits))


def size_or_zero(c) -> Column:
    """Array length, 0 for a NULL array (independent of the session's
    legacy ``sizeOfNull`` setting)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(c))

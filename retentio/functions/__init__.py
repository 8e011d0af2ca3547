"""Column-expression builders (JVM-side, no Python UDFs)."""

from retentio.functions.dates import as_of_date, days_between, parse_date, to_utc_date
from retentio.functions.numbers import (bad_number, div_or_zero, finite_or_null, nan_to_null,
                                        number_or_zero, round4)

__all__ = ["as_of_date", "days_between", "parse_date", "to_utc_date", "bad_number",
           "div_or_zero", "finite_or_null", "nan_to_null", "number_or_zero", "round4"]

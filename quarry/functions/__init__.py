"""Members of values that paths may end on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIME = {
    "Year": (F.year, T.IntegerType()),
    "Month": (F.month, T.IntegerType()),
    "Day": (F.dayofmonth, T.IntegerType()),
    "Hour": (F.hour, T.IntegerType()),
    "Minute": (F.minute, T.IntegerType()),
    "Second": (F.second, T.IntegerType()),
    "Millisecond": (lambda c: (F.date_format(c, "SSS")).cast("int"), T.IntegerType()),
    "DayOfYear": (F.dayofyear, T.IntegerType()),
    "DayOfWeek": (lambda c: F.dayofweek(c) - 1, T.IntegerType()),
    "Date": (F.to_date, T.DateType()),
    "TimeOfDay": (lambda c: F.date_format(c, "HH:mm:ss"), T.StringType()),
    # 100 ns since 0001-01-01; 719162 days lie between that and 1970-01-01.
    "Ticks": (lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz")) * 10 + F.lit(719162 * 864_000_000_000), T.LongType()),
}
_TEXT = {"Length": (F.length, T.IntegerType())}
_ANY = {"Value": (lambda c: c, None), "HasValue": (lambda c: c.isNotNull(), T.BooleanType())}


def member(kind: T.DataType, name: str) -> tuple[str, Callable[[Column], Column], T.DataType] | None:
    """(name as declared, function, type) of a value's member, in any case."""
    own = dict(_ANY)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        own |= _TIME
    if isinstance(kind, T.StringType):
        own |= _TEXT
    for declared, (f, out) in own.items():
        if declared.lower() == name.lower():
            return declared, f, out or kind
    return None

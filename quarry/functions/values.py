"""Condition values: canonical text, number and format checks, literals."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..model import Condition, DataType, Operator

_MANY = {Operator.In, Operator.IIn, Operator.NotIn, Operator.INotIn}
_TWO = {Operator.Between, Operator.NotBetween}
_NONE = {Operator.IsNull, Operator.IsNotNull}
_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\Z")


def normalize(value: Any) -> str:
    """A value as trimmed text: null is empty, booleans are lower case, numbers keep their digits."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list)):
        return json.dumps(value, default=str)
    if isinstance(value, datetime):
        return value.isoformat()
    return str(value).strip()


def moment(text: str) -> datetime:
    """ISO 8601; with an offset it is turned to UTC, and the result has no zone."""
    try:
        got = datetime.fromisoformat(text)
    except ValueError:
        raise E.LogicError(E.INVALID_FORMAT) from None
    return got.astimezone(timezone.utc).replace(tzinfo=None) if got.tzinfo else got


def parsed(kind: DataType, text: str) -> Any:
    if kind is DataType.Guid:
        try:
            return str(uuid.UUID(text.strip("{}()")))
        except ValueError:
            raise E.LogicError(E.INVALID_FORMAT) from None
    if kind is DataType.Number:
        if not _NUMBER.match(text):
            raise E.LogicError(E.INVALID_FORMAT)
        try:
            return Decimal(text)
        except InvalidOperation:
            raise E.LogicError(E.INVALID_FORMAT) from None
    if kind is DataType.Boolean:
        if text.lower() not in ("true", "false"):
            raise E.LogicError(E.INVALID_FORMAT)
        return text.lower() == "true"
    if kind is DataType.DateTime:
        return moment(text)
    if kind is DataType.Date:
        return moment(text).date()
    return text


def checked(condition: Condition) -> list[Any]:
    """A condition's parsed values, after its number of values and their formats are checked."""
    op, values = condition.operator, [normalize(v) for v in condition.values]
    if op in _TWO and len(values) != 2:
        raise E.LogicError(E.REQUIRED_TWO_VALUE)
    if op in _MANY and not values:
        raise E.LogicError(E.REQUIRED_VALUES)
    if op in _NONE and values:
        raise E.LogicError(E.NOT_REQUIRED_VALUES)
    if op not in _TWO | _MANY | _NONE and len(values) != 1:
        raise E.LogicError(E.required_one_value(op.value))
    return [parsed(condition.data_type, v) for v in values]


def literal(value: Any, kind: T.DataType | None) -> Column:
    """A literal that compares with a column of a kind without a cast of the column."""
    if isinstance(value, Decimal):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.lit(float(value))
        if value == value.to_integral_value() and abs(value) < 1 << 63:
            whole = int(value)
            return F.lit(whole).cast(kind) if isinstance(kind, T.IntegerType) and abs(whole) < 1 << 31 else F.lit(whole)
        if abs(value) >= Decimal(10) ** 38 or value.as_tuple().exponent < -37:
            return F.lit(float(value))
        return F.lit(value)
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz" if not isinstance(kind, T.TimestampType) else "timestamp")
    return F.lit(value)


def type_default(kind: T.DataType) -> Column:
    """The default of a value type, null of any other."""
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit("0001-01-01").cast(kind)
    return F.lit(None).cast(kind)

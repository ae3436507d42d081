"""Request objects, immutable, read from JSON with keys in any case and enums by name or ordinal."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from decimal import Decimal
from enum import Enum
from typing import Any, get_args, get_origin, get_type_hints

from .errors import UnknownName


class Named(Enum):
    @classmethod
    def read(cls, value: Any):
        if isinstance(value, cls):
            return value
        members = list(cls)
        if isinstance(value, (int, Decimal)) and not isinstance(value, bool):
            if 0 <= int(value) < len(members):
                return members[int(value)]
            raise UnknownName(f"{value!r} is no {cls.__name__}")
        for m in members:
            if m.value.lower() == str(value).strip().lower():
                return m
        raise UnknownName(f"{value!r} is no {cls.__name__}")


def _enum(name: str, values: str) -> type[Named]:
    return Named(name, {v: v for v in values.split()})


Connector = _enum("Connector", "And Or")
Direction = _enum("Direction", "Ascending Descending")
Intersection = _enum("Intersection", "Union Intersect Except")
Aggregator = _enum("Aggregator", "Count CountDistinct Sumation Average Minimum Maximum FirstOrDefault LastOrDefault")
DataType = _enum("DataType", "Text Guid Number Boolean DateTime Date Enum")
Operator = _enum(
    "Operator",
    "Equal IEqual NotEqual INotEqual Contains IContains NotContains INotContains StartsWith IStartsWith NotStartsWith "
    "INotStartsWith EndsWith IEndsWith NotEndsWith INotEndsWith In IIn NotIn INotIn GreaterThan GreaterThanOrEqual LessThan "
    "LessThanOrEqual Between NotBetween IsNull IsNotNull",
)


class Request:
    @classmethod
    def from_json(cls, source: str | bytes | dict | Request):
        if isinstance(source, cls):
            return source
        data = json.loads(source, parse_float=Decimal) if isinstance(source, (str, bytes)) else source
        hints, given = get_type_hints(cls), {k.lower().replace("_", ""): v for k, v in data.items()}
        out = {}
        for f in fields(cls):
            key = f.name.replace("_", "")
            if key in given:
                out[f.name] = _read(hints[f.name], given[key])
        return cls(**out)


def _read(kind: Any, value: Any) -> Any:
    if get_origin(kind) is tuple:
        return None if value is None else tuple(_read(get_args(kind)[0], v) for v in value)
    for option in get_args(kind) or (kind,):
        if get_origin(option) is tuple and value is not None:
            return _read(option, value)
        if isinstance(option, type) and issubclass(option, Named) and value is not None:
            return option.read(value)
        if isinstance(option, type) and issubclass(option, Request) and value is not None:
            return option.from_json(value)
        if option is int and value is not None:
            return int(value)
    return value


@dataclass(frozen=True)
class Condition(Request):
    sort: int = 0
    field: str | None = None
    data_type: DataType = DataType.Text
    operator: Operator = Operator.Equal
    values: tuple[Any, ...] = ()


@dataclass(frozen=True)
class ConditionGroup(Request):
    sort: int = 0
    connector: Connector = Connector.And
    conditions: tuple[Condition, ...] = ()
    sub_condition_groups: tuple[ConditionGroup, ...] = ()


@dataclass(frozen=True)
class ConditionSet(Request):
    sort: int = 0
    intersection: Intersection | None = None
    condition_group: ConditionGroup = ConditionGroup()


@dataclass(frozen=True)
class OrderBy(Request):
    sort: int = 0
    field: str | None = None
    direction: Direction = Direction.Ascending


@dataclass(frozen=True)
class AggregateBy(Request):
    field: str | None = None
    alias: str | None = None
    aggregator: Aggregator = Aggregator.Count


@dataclass(frozen=True)
class GroupBy(Request):
    fields: tuple[str, ...] = ()
    aggregate_by: tuple[AggregateBy, ...] = ()


@dataclass(frozen=True)
class PageBy(Request):
    page_number: int = 0
    page_size: int = 0


@dataclass(frozen=True)
class Filter(Request):
    condition_group: ConditionGroup | None = None
    selects: tuple[str, ...] | None = None
    orders: tuple[OrderBy, ...] | None = None
    page: PageBy | None = None


@dataclass(frozen=True)
class Segment(Request):
    condition_sets: tuple[ConditionSet, ...] = ()
    selects: tuple[str, ...] | None = None
    orders: tuple[OrderBy, ...] | None = ()
    page: PageBy | None = None


@dataclass(frozen=True)
class Summary(Request):
    condition_group: ConditionGroup | None = None
    group_by: GroupBy | None = None
    having: ConditionGroup | None = None
    orders: tuple[OrderBy, ...] | None = None
    page: PageBy | None = None

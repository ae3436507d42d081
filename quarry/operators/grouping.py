"""Group keys, aggregates and having."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..model import AggregateBy, Aggregator, ConditionGroup, GroupBy
from ..plans.frames import Frame
from ..plans.paths import Path, is_simple, resolve
from .predicates import folded, leaf


def key_alias(field: str) -> str:
    return field.replace(".", "")


def is_identifier(alias: str | None) -> bool:
    """A letter or underscore, then letters, digits and underscores, of any script."""
    if not alias:
        return False
    return (alias[0] == "_" or alias[0].isalpha()) and all(c == "_" or c.isalnum() for c in alias[1:])


def _checked_aggregate(frame: Frame, a: AggregateBy) -> Path | None:
    if not is_identifier(a.alias):
        raise E.LogicError(E.INVALID_ALIAS)
    if a.aggregator is Aggregator.Count:
        return None
    if not (a.field or "").strip():
        raise E.LogicError(E.INVALID_FIELD)
    path = resolve(frame.catalog, frame.entity, a.field)
    if path.last.kind == "scalars" or path.crosses_collection():
        raise E.LogicError(E.AGGREGATION_FIELD_COLLECTION)
    if not is_simple(path.type):
        raise E.LogicError(E.AGGREGATION_FIELD_SIMPLE)
    numeric = isinstance(path.type, T.NumericType)
    if a.aggregator in (Aggregator.Sumation, Aggregator.Average) and not numeric:
        raise E.LogicError(E.unsupported_aggregator(a.aggregator.value, path.type.simpleString()))
    if a.aggregator in (Aggregator.Minimum, Aggregator.Maximum) and isinstance(path.type, T.BooleanType):
        raise E.LogicError(E.unsupported_aggregator(a.aggregator.value, path.type.simpleString()))
    return path


def validated(frame: Frame, by: GroupBy) -> tuple[list[Path], list[Path | None]]:
    if not by.fields:
        raise E.LogicError(E.GROUP_BY_FIELDS)
    if any(not (f or "").strip() for f in by.fields):
        raise E.LogicError(E.INVALID_FIELD)
    if len({f.lower() for f in by.fields}) < len(by.fields):
        raise E.LogicError(E.GROUP_BY_UNIQUE)
    keys = []
    for f in by.fields:
        path = resolve(frame.catalog, frame.entity, f)
        if path.last.kind == "scalars" or path.crosses_collection():
            raise E.LogicError(E.GROUP_BY_COLLECTION)
        if not is_simple(path.type):
            raise E.LogicError(E.GROUP_BY_COMPLEX)
        keys.append(path)
    values = [_checked_aggregate(frame, a) for a in by.aggregate_by]
    aliases = [a.alias.lower() for a in by.aggregate_by]
    if len(set(aliases)) < len(aliases):
        raise E.LogicError(E.ALIASES_UNIQUE)
    taken = {f.lower() for f in by.fields} | {key_alias(p.text).lower() for p in keys}
    for a in by.aggregate_by:
        if a.alias.lower() in taken:
            raise E.LogicError(E.alias_is_group_field(a.alias))
    return keys, values


def aggregate(kind: Aggregator, c: Column | None) -> Column:
    if kind is Aggregator.Count:
        return F.count(F.lit(1))
    return {
        Aggregator.CountDistinct: lambda: F.count_distinct(c),
        Aggregator.Sumation: lambda: F.coalesce(F.sum(c), F.lit(0)),
        Aggregator.Average: lambda: F.avg(c),
        Aggregator.Minimum: lambda: F.min(c),
        Aggregator.Maximum: lambda: F.max(c),
        # First and last are by value: nulls come first, so any null makes the first null.
        Aggregator.FirstOrDefault: lambda: F.when(F.count(c) == F.count(F.lit(1)), F.min(c)),
        Aggregator.LastOrDefault: lambda: F.max(c),
    }[kind]()


def grouped(frame: Frame, by: GroupBy) -> DataFrame:
    keys, values = validated(frame, by)
    key_cols = [frame.value(p).alias(key_alias(p.text)) for p in keys]
    agg_cols = [aggregate(a.aggregator, None if p is None else frame.value(p)).alias(a.alias) for a, p in zip(by.aggregate_by, values)]
    rows = frame.df.groupBy(*key_cols)
    return rows.agg(*agg_cols) if agg_cols else frame.df.select(*key_cols).distinct()


def having(df: DataFrame, by: GroupBy, g: ConditionGroup) -> Column | None:
    """Conditions on aliases of aggregates only."""
    aliases = {a.alias.lower(): a.alias for a in by.aggregate_by}

    def one(c) -> Column:
        if not (c.field or "").strip():
            raise E.LogicError(E.INVALID_FIELD)
        name = aliases.get(c.field.strip().lower())
        if name is None:
            raise E.LogicError(E.having_field(c.field))
        return leaf(c, df.schema[name].dataType)(F.col(f"`{name}`"))

    return folded(g, one)

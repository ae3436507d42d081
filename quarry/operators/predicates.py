"""Conditions as two-valued columns; nothing is built from text, so values can't change a plan's shape."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..functions.values import checked, literal
from ..model import Condition, ConditionGroup, Connector, DataType, Operator
from ..plans.frames import Frame, inner, name_of, quoted
from ..plans.paths import Path, Step, resolve

Test = Callable[[Column], Column]

_TEXT = {
    "Equal": lambda c, v: c == v[0],
    "Contains": lambda c, v: c.contains(v[0]),
    "StartsWith": lambda c, v: c.startswith(v[0]),
    "EndsWith": lambda c, v: c.endswith(v[0]),
    "In": lambda c, v: c.isin(*v),
}
_ORDERED = {
    "Equal": lambda c, v: c == v[0],
    "GreaterThan": lambda c, v: c > v[0],
    "GreaterThanOrEqual": lambda c, v: c >= v[0],
    "LessThan": lambda c, v: c < v[0],
    "LessThanOrEqual": lambda c, v: c <= v[0],
    "Between": lambda c, v: (c >= v[0]) & (c <= v[1]),
}
_NOT = {"Equal", "Contains", "StartsWith", "EndsWith", "In", "Between"}


def _table() -> dict[tuple[str, str], Callable[[Column, list[Column]], Column]]:
    """The supported (type, operator) pairs but for IsNull and IsNotNull, which every type has."""
    out = {}

    def put(kind: str, ops: dict, fold: bool = False) -> None:
        for name, f in ops.items():
            out[kind, name] = f
            if name in _NOT:
                out[kind, "Not" + name] = lambda c, v, f=f: ~f(c, v)
            if fold:
                low = lambda c, v, f=f: f(F.lower(c), [F.lower(x) for x in v])
                out[kind, "I" + name] = low
                out[kind, "INot" + name] = lambda c, v, f=low: ~f(c, v)

    put("Text", _TEXT, fold=True)
    put("Enum", _TEXT)
    put("Guid", {k: (lambda c, v, f=_TEXT[k]: f(F.lower(c), v)) for k in ("Equal", "In")})
    put("Number", _ORDERED | {"In": _TEXT["In"]})
    put("Boolean", {"Equal": _ORDERED["Equal"]})
    put("DateTime", _ORDERED)
    put("Date", _ORDERED)
    return out


PAIRS = _table()


def leaf(condition: Condition, kind: T.DataType | None) -> Test:
    """The test of one value; null fails every operator but IsNull."""
    values = checked(condition)
    data_type, op = condition.data_type, condition.operator
    if op is Operator.IsNull:
        return lambda c: c.isNull()
    if op is Operator.IsNotNull:
        return lambda c: c.isNotNull()
    f = PAIRS.get((data_type.value, op.value))
    if f is None:
        raise E.LogicError(f"Unsupported combination of DataType '{data_type.value}' and Operator '{op.value}'.")
    literals = [literal(v, kind) for v in values]
    on_date = data_type is DataType.Date and not isinstance(kind, T.DateType)

    def test(c: Column) -> Column:
        return c.isNotNull() & f(F.to_date(c) if on_date else c, literals)

    return test


def _any(frame: Frame, steps: tuple[Step, ...], test: Test) -> Column:
    """The test under every collection crossed: some element passes."""
    prefix, steps = frame.enter(steps)
    if steps and steps[0].kind == "coll":
        sub, fk, key = frame.children(prefix, steps[0])
        passed = _any(sub, steps[1:], test) if steps[1:] else F.lit(True)
        rows = sub.df.where(passed).select(quoted(fk).alias("__fk"))
        return rows.where(F.col("__fk") == frame.unique(key).outer()).exists()
    if not steps:
        raise E.LogicError(E.INVALID_FIELD)
    return _any_value(quoted(name_of(prefix, steps[0].name)), steps, test)


def _any_value(col: Column, steps: tuple[Step, ...], test: Test) -> Column:
    """col is the first step's value."""
    for i, s in enumerate(steps):
        if i:
            col = inner(col, (s,))
        if s.kind == "array" and i + 1 < len(steps):
            rest = steps[i + 1 :]
            return F.coalesce(F.exists(col, lambda x: _any_value(x.getField(rest[0].name), rest, test)), F.lit(False))
    return test(col)


def year_range(c: Condition, kind: T.DataType | None) -> Test | None:
    """A condition on a time's year as half-open ranges of the time, which a scan can use; None if it isn't one of whole years."""
    if c.data_type is not DataType.Number or not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return None
    name = c.operator.value
    positive = name.removeprefix("Not")
    if positive not in ("Equal", "In", "Between", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual"):
        return None
    years = checked(c)
    if any(y != y.to_integral_value() or not 0 < y < 9999 for y in years):
        return None
    start = lambda y: F.lit(f"{int(y):04d}-01-01").cast(kind)
    inside = lambda x, a, b: (x >= start(a)) & (x < start(b + 1))
    tests: dict[str, Test] = {
        "Equal": lambda x: inside(x, years[0], years[0]),
        "In": lambda x: reduce(lambda a, b: a | b, [inside(x, y, y) for y in years]),
        "Between": lambda x: inside(x, years[0], years[1]),
        "GreaterThan": lambda x: x >= start(years[0] + 1),
        "GreaterThanOrEqual": lambda x: x >= start(years[0]),
        "LessThan": lambda x: x < start(years[0]),
        "LessThanOrEqual": lambda x: x < start(years[0] + 1),
    }
    test = tests[positive]
    return lambda x: x.isNotNull() & (~test(x) if name.startswith("Not") else test(x))


def condition(frame: Frame, c: Condition) -> Column:
    path = resolve(frame.catalog, frame.entity, c.field)
    if path.last.kind == "scalars":
        return _membership(frame, path, c)
    if path.last.kind == "member" and path.last.name == "Year" and (test := year_range(c, path.steps[-2].type)) is not None:
        return _any(frame, path.steps[:-1], test)
    test = leaf(c, path.type)
    if c.data_type is DataType.Guid and c.operator.value in _AS_IS and path.last.canonical:
        literals = [F.lit(v) for v in checked(c)]
        return _any(frame, path.steps, lambda x: x.isNotNull() & _AS_IS[c.operator.value](x, literals))
    return _any(frame, path.steps, test)


_AS_IS = {"Equal": _TEXT["Equal"], "In": _TEXT["In"], "NotEqual": lambda c, v: c != v[0], "NotIn": lambda c, v: ~c.isin(*v)}


def _membership(frame: Frame, path: Path, c: Condition) -> Column:
    """A list of values supports Contains, and IsNull for the list itself."""
    values = checked(c)
    tests: dict[Operator, Test] = {
        Operator.Contains: lambda x: F.coalesce(F.array_contains(x, literal(values[0], path.type.elementType)), F.lit(False)),
        Operator.NotContains: lambda x: x.isNotNull() & ~F.coalesce(F.array_contains(x, literal(values[0], path.type.elementType)), F.lit(False)),
        Operator.IsNull: lambda x: x.isNull(),
        Operator.IsNotNull: lambda x: x.isNotNull(),
    }
    if c.operator not in tests:
        raise E.LogicError(f"Unsupported combination of DataType '{c.data_type.value}' and Operator '{c.operator.value}'.")
    return _any(frame, path.steps, tests[c.operator])


def check_sorts(g: ConditionGroup) -> None:
    if len({c.sort for c in g.conditions}) < len(g.conditions):
        raise E.LogicError(E.CONDITIONS_UNIQUE_SORT)
    if len({s.sort for s in g.sub_condition_groups}) < len(g.sub_condition_groups):
        raise E.LogicError(E.SUB_GROUPS_UNIQUE_SORT)


def folded(g: ConditionGroup, one: Callable[[Condition], Column]) -> Column | None:
    """Conditions, then sub-groups, each by Sort, under the group's connector; None if there is none."""
    check_sorts(g)
    parts = [one(c) for c in sorted(g.conditions, key=lambda c: c.sort)]
    parts += [p for s in sorted(g.sub_condition_groups, key=lambda s: s.sort) if (p := folded(s, one)) is not None]
    if not parts:
        return None
    return reduce((lambda a, b: a & b) if g.connector is Connector.And else (lambda a, b: a | b), parts)


def group(frame: Frame, g: ConditionGroup) -> Column | None:
    return folded(g, lambda c: condition(frame, c))

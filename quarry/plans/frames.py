"""Navigation as joins: one left join for each reference prefix, EXISTS and grouped joins for collections."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import type_default
from ..sources import Catalog, Entity
from .paths import Path, Step

_count = itertools.count()


def name_of(prefix: tuple[str, ...], field: str) -> str:
    return ".".join((*prefix, field))


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


class Frame:
    """An entity's rows, with parents joined once a prefix under names like Customer.Nation.n_name.

    few: the rows are a page, or what belongs to one, so collections are cut to them before they are grouped."""

    def __init__(self, catalog: Catalog, entity: Entity, df: DataFrame | None = None, few: bool = False):
        self.catalog, self.entity, self.few = catalog, entity, few
        self.df = entity.df if df is None else df
        self.base = list(self.df.columns)
        self.joined: dict[tuple[str, ...], Entity] = {(): entity}

    def ensure(self, prefix: tuple[str, ...]) -> Entity:
        if prefix in self.joined:
            return self.joined[prefix]
        parent = self.ensure(prefix[:-1])
        ref = parent.refs[prefix[-1]]
        target = self.catalog[ref.target]
        right = target.df.select(*[quoted(c).alias(name_of(prefix, c)) for c in target.df.columns])
        on = quoted(name_of(prefix[:-1], ref.fk)) == quoted(name_of(prefix, ref.pk))
        self.df = self.df.join(right, on, "left")
        self.joined[prefix] = target
        return target

    def enter(self, steps: tuple[Step, ...]) -> tuple[tuple[str, ...], tuple[Step, ...]]:
        """Joins the leading references; the prefix and the steps after them."""
        prefix: tuple[str, ...] = ()
        while steps and steps[0].kind == "ref":
            prefix, steps = (*prefix, steps[0].name), steps[1:]
            self.ensure(prefix)
        return prefix, steps

    def value(self, path: Path) -> Column:
        """A path without a collection before its end."""
        prefix, steps = self.enter(path.steps)
        if not steps:  # a whole parent
            return F.struct(*[quoted(name_of(prefix, c)).alias(c) for c in self.joined[prefix].df.columns])
        return inner(quoted(name_of(prefix, steps[0].name)), steps[1:])

    def children(self, prefix: tuple[str, ...], step: Step) -> tuple[Frame, str, str]:
        """(the collection's rows, their foreign key, this frame's key column)."""
        coll = self.joined[prefix].colls[step.name]
        return Frame(self.catalog, step.entity), coll.fk, name_of(prefix, coll.pk)

    def own_children(self, prefix: tuple[str, ...], step: Step) -> tuple[Frame, str, str]:
        """As :meth:`children`; of few rows, their children alone: a semi-join that the planner can push below the grouping."""
        sub, fk, key = self.children(prefix, step)
        if self.few:
            name = f"__k{next(_count)}"
            keys = self.df.select(quoted(key).alias(name)).distinct()
            sub = Frame(self.catalog, step.entity, sub.df.join(keys, quoted(fk) == F.col(name), "left_semi"), True)
        return sub, fk, key

    def unique(self, name: str) -> Column:
        """A column under a name that no other frame has: inside EXISTS, a name the collection has too would mean its own."""
        alias = f"__k{next(_count)}"
        self.df = self.df.withColumn(alias, quoted(name))
        return F.col(alias)

    def attach(self, right: DataFrame, fk: str, key: str, value: str) -> Column:
        """Left-joins (fk, value), unique in fk; the value's column."""
        fk_name, out = f"__fk{next(_count)}", f"__v{next(_count)}"
        right = right.select(quoted(fk).alias(fk_name), quoted(value).alias(out))
        self.df = self.df.join(right, quoted(key) == F.col(fk_name), "left").drop(fk_name)
        return F.col(out)

    def order_key(self, path: Path, descending: bool) -> Column:
        """The path's value; across collections the least (ascending) or greatest of each level.

        Where the leaf holds no null, an empty level counts as the type's default.
        """
        return self._reduced(path.steps, descending)

    def _reduced(self, steps: tuple[Step, ...], descending: bool) -> Column:
        prefix, steps = self.enter(steps)
        at = next((i for i, s in enumerate(steps) if s.kind in ("coll", "array", "scalars")), None)
        if at is None:
            return inner(quoted(name_of(prefix, steps[0].name)), steps[1:])
        if steps[at].kind != "coll":
            return _reduced_array(inner(quoted(name_of(prefix, steps[0].name)), steps[1 : at + 1]), steps[at:], descending)
        sub, fk, key = self.children(prefix, steps[at])
        sub_key = sub._reduced(steps[at + 1 :], descending)
        grouped = sub.df.groupBy(quoted(fk).alias("__g")).agg((F.max if descending else F.min)(sub_key).alias("__m"))
        return _defaulted(self.attach(grouped, "__g", key, "__m"), steps[-1])


def inner(col: Column, steps: tuple[Step, ...]) -> Column:
    """Struct fields and members under a column."""
    for s in steps:
        col = s.call(col) if s.kind == "member" else col.getField(s.name)
    return col


def _defaulted(col: Column, leaf: Step) -> Column:
    return F.coalesce(col, type_default(leaf.type)) if leaf.required else col


def _reduced_array(arr: Column, steps: tuple[Step, ...], descending: bool) -> Column:
    pick = F.array_max if descending else F.array_min
    if steps[0].kind == "scalars":
        return pick(arr)
    rest = steps[1:]

    def level(x: Column) -> Column:
        at = next((i for i, s in enumerate(rest) if s.kind in ("array", "scalars")), None)
        if at is None:
            return inner(x, rest)
        return _reduced_array(inner(x, rest[: at + 1]), rest[at:], descending)

    return _defaulted(pick(F.transform(arr, level)), steps[-1])

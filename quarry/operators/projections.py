"""Typed and dynamic projections as nested structs and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..functions.values import type_default
from ..plans.frames import Frame, inner, name_of, quoted
from ..plans.paths import Path, Step, resolve
from ..sources import Entity

Tree = dict[str, tuple[Step, "Tree"]]


def tree_of(paths: list[Path]) -> Tree:
    """Selected steps by name; where a whole and its parts are both asked for, the parts win."""
    root: Tree = {}
    for path in paths:
        at = root
        for step in path.steps:
            at = at.setdefault(step.name, (step, {}))[1]
    return root


def _ordered(tree: Tree, typed: bool) -> list[tuple[Step, Tree]]:
    """Leaves first.  A typed projection skips members of values."""
    nodes = [n for n in tree.values() if not (typed and n[0].kind == "member")]
    return [n for n in nodes if not n[1]] + [n for n in nodes if n[1]]


class Projector:
    def __init__(self, typed: bool):
        self.typed = typed

    def _with_id(self, tree: Tree, names: list[str], make) -> Tree:
        """Typed nested objects hold their Id, if they have one."""
        found = next((n for n in names if n.lower() == "id"), None)
        if not self.typed or found is None or found in tree:
            return tree
        return {found: (make(found), {}), **tree}

    def columns(self, frame: Frame, prefix: tuple[str, ...], tree: Tree) -> list[Column]:
        out = []
        for step, below in _ordered(tree, self.typed):
            if step.kind == "ref":
                out.append(self._ref(frame, prefix, step, below).alias(step.name))
            elif step.kind == "coll":
                out.append(self._coll(frame, prefix, step, below).alias(step.name))
            elif (got := self._value(quoted(name_of(prefix, step.name)), step, below)) is not None:
                out.append(got.alias(step.name))
        return out

    def _entity_tree(self, entity: Entity, tree: Tree) -> Tree:
        fields = {f.name: f.dataType for f in entity.df.schema}
        make = lambda n: Step("field", n, fields[n])
        if not tree:
            return {n: (make(n), {}) for n in fields}
        return self._with_id(tree, list(fields), make)

    def _ref(self, frame: Frame, prefix: tuple[str, ...], step: Step, tree: Tree) -> Column:
        own = (*prefix, step.name)
        target = frame.ensure(own)
        whole = not tree
        tree = self._entity_tree(target, tree)
        parts = self.columns(frame, own, tree)
        made = F.struct(*parts)
        missing = quoted(name_of(own, frame.joined[prefix].refs[step.name].pk)).isNull()
        if not self.typed:
            return F.when(~missing, made) if whole else made
        # A missing parent becomes an object with the members' defaults.
        filled = []
        for (node, _), part in zip(_ordered(tree, True), parts):
            if node.name in target.defaults:
                part = F.when(missing, F.lit(target.defaults[node.name])).otherwise(part)
            elif node.kind == "field" and isinstance(node.type, (T.NumericType, T.BooleanType)):
                part = F.when(missing, type_default(node.type)).otherwise(part)
            filled.append(part.alias(node.name))
        return F.struct(*filled)

    def _coll(self, frame: Frame, prefix: tuple[str, ...], step: Step, tree: Tree) -> Column:
        """The collection as a list in order of the element's key; without a key, by the selected values.

        A list is one value of one row, made in one task: select collections of a page."""
        sub, fk, key = frame.own_children(prefix, step)
        parts = self.columns(sub, (), self._entity_tree(step.entity, tree))
        ordered = [quoted(k) for k in step.entity.key] or parts
        item = F.struct(F.struct(*ordered).alias("o"), F.struct(*parts).alias("v"))
        lists = sub.df.groupBy(quoted(fk).alias("__g")).agg(F.sort_array(F.collect_list(item)).alias("__l"))
        got = frame.attach(lists.select("__g", F.col("__l").getField("v").alias("__l")), "__g", key, "__l")
        return F.coalesce(got, F.array())

    def _value(self, col: Column, step: Step, tree: Tree) -> Column | None:
        if not tree:
            return col
        if step.kind == "array":
            return F.coalesce(F.transform(col, lambda x: self._struct(x, step.type.elementType, tree)), F.array())
        if isinstance(step.type, T.StructType):
            return self._struct(col, step.type, tree)
        if self.typed:
            return None  # members of values are no typed fields
        return F.struct(*[inner(col, (n,)).alias(n.name) for n, _ in tree.values()])

    def _struct(self, col: Column, kind: T.StructType, tree: Tree) -> Column:
        tree = self._with_id(tree, kind.names, lambda n: Step("field", n, kind[n].dataType))
        parts = []
        for step, below in _ordered(tree, self.typed):
            if (got := self._value(col.getField(step.name), step, below)) is not None:
                parts.append(got.alias(step.name))
        return F.struct(*parts)


def paths_of(frame: Frame, selects) -> list[Path]:
    if selects is None:
        raise TypeError("selects is None")
    if not selects:
        raise E.LogicError(E.MUST_HAVE_FIELDS)
    return [resolve(frame.catalog, frame.entity, s) for s in selects]


def project(frame: Frame, selects, typed: bool = True, fill_defaults: bool = False) -> list[Column]:
    """Columns of the selected paths; joins they need are added to the frame."""
    tree = tree_of(paths_of(frame, selects))
    out = Projector(typed).columns(frame, (), tree)
    if fill_defaults and typed:
        own, rest = frame.entity, [f for f in frame.entity.df.schema if f.name not in tree]
        out += [(F.lit(own.defaults[f.name]) if f.name in own.defaults else type_default(f.dataType)).alias(f.name) for f in rest]
    return out

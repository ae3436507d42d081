"""Dotted paths, resolved in any case against entities, structs, arrays and members of values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

from .. import errors as E
from ..functions import member
from ..sources import Catalog, Entity
from .cache import CACHE, Store


@dataclass(frozen=True)
class Step:
    """kind: ref, coll (navigations), field (column or struct field), array (of structs), scalars (of values), member."""

    kind: str
    name: str
    type: T.DataType | None = None
    entity: Entity | None = None
    call: Callable[[Column], Column] | None = None
    required: bool = False
    canonical: bool = False


def is_simple(kind: T.DataType | None) -> bool:
    return kind is not None and not isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]

    @property
    def text(self) -> str:
        return ".".join(s.name for s in self.steps)

    @property
    def last(self) -> Step:
        return self.steps[-1]

    @property
    def type(self) -> T.DataType | None:
        return self.last.type

    def crosses_collection(self) -> bool:
        return any(s.kind in ("coll", "array") for s in self.steps[:-1])

    def ends_on_collection(self) -> bool:
        return self.last.kind in ("coll", "array", "scalars")


def _value_step(name: str, kind: T.DataType, required: bool, canonical: bool = False) -> Step:
    if isinstance(kind, T.ArrayType):
        return Step("array" if isinstance(kind.elementType, T.StructType) else "scalars", name, kind)
    return Step("field", name, kind, required=required, canonical=canonical)


def _walk(catalog: Catalog, entity: Entity, parts: list[str]) -> Path:
    at: Entity | T.DataType = entity
    steps = []
    for part in parts:
        step = None
        if isinstance(at, Entity):
            name = CACHE.get(Store.TypeProperties, at.uid, at.members).get(part.lower())
            if name in at.df.columns:
                step = _value_step(name, at.df.schema[name].dataType, name in at.required, name in at.canonical_guids)
            elif name in at.refs:
                step = Step("ref", name, entity=catalog[at.refs[name].target])
            elif name in at.colls:
                step = Step("coll", name, entity=catalog[at.colls[name].target])
        elif isinstance(at, T.StructType):
            found = {f.name.lower(): f for f in at.fields}.get(part.lower())
            step = found and _value_step(found.name, found.dataType, not found.nullable)
        elif (got := member(at, part)) is not None:
            step = Step("member", got[0], got[2], call=got[1], required=steps[-1].required if steps else False)
        if step is None:
            raise E.LogicError(E.INVALID_FIELD)
        steps.append(step)
        at = step.entity or (step.type.elementType if isinstance(step.type, T.ArrayType) else step.type)
    return Path(tuple(steps))


def resolve(catalog: Catalog, entity: Entity, path: str | None) -> Path:
    """The path as steps; blank segments are dropped, an unknown one is an invalid field."""
    if path is None or not path.strip():
        raise E.LogicError(E.INVALID_FIELD)
    parts = [p.strip() for p in path.split(".") if p.strip()]
    if not parts:
        raise E.LogicError(E.INVALID_FIELD)
    key = (catalog.uid, entity.uid, ".".join(parts).lower())
    return CACHE.get(Store.PropertyPath, key, lambda: _walk(catalog, entity, parts))


# Lookups over entities and types, each kept in the metadata cache.


def type_properties(entity: Entity) -> dict[str, str]:
    """An entity's members by their lower-case names: columns, references and collections."""
    return dict(CACHE.get(Store.TypeProperties, entity.uid, entity.members))


def find_property(entity: Entity, name: str) -> str | None:
    """The member as declared, None if there is none."""
    return type_properties(entity).get((name or "").strip().lower())


def element_type(catalog: Catalog, entity: Entity, path: str) -> Entity | T.DataType | None:
    """What a collection at a path holds: an entity or a type; None if the path doesn't end on a collection."""

    def made():
        last = resolve(catalog, entity, path).last
        return last.entity if last.kind == "coll" else last.type.elementType if last.kind in ("array", "scalars") else None

    return CACHE.get(Store.CollectionElementType, (catalog.uid, entity.uid, path.strip().lower()), made)


def is_collection(catalog: Catalog, entity: Entity, path: str) -> bool:
    return element_type(catalog, entity, path) is not None


def validated_path(catalog: Catalog, entity: Entity, path: str) -> str:
    """The path as declared."""
    return resolve(catalog, entity, path).text


def warmup(catalog: Catalog, entity: Entity | str, *paths: str) -> int:
    """Fills the cache with an entity's members and the given paths before requests ask for them; unknown paths are passed over.

    Returns how many paths were resolved."""
    entity = catalog[entity] if isinstance(entity, str) else entity
    type_properties(entity)
    found = 0
    for path in paths:
        try:
            element_type(catalog, entity, path)
            found += 1
        except E.LogicError:
            continue
    return found

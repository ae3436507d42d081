"""Entities: DataFrames with keys, references and collections, and where their rows come from."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnknownName


_uids = itertools.count()


@dataclass(frozen=True)
class Ref:
    """Many to one: this entity's column fk holds the target's column pk."""

    target: str
    fk: str
    pk: str


@dataclass(frozen=True)
class Coll:
    """One to many: the target's column fk holds this entity's column pk."""

    target: str
    pk: str
    fk: str


@dataclass
class Entity:
    name: str
    df: DataFrame
    key: tuple[str, ...] = ()
    refs: dict[str, Ref] = field(default_factory=dict)
    colls: dict[str, Coll] = field(default_factory=dict)
    #: Columns that hold no null: an empty collection's least or greatest is then the type's default.
    required: frozenset[str] = frozenset()
    #: Values of a missing parent's members where they differ from the type's default.
    defaults: dict[str, object] = field(default_factory=dict)
    #: Text columns whose guids are all in lower-case canonical form, so that conditions compare them as they are.
    canonical_guids: frozenset[str] = frozenset()
    #: Names this object in metadata caches.
    uid: int = field(default_factory=_uids.__next__, init=False)

    def members(self) -> dict[str, str]:
        """Names as declared by their lower case; columns hide navigations of the same name."""
        names = [*self.refs, *self.colls, *self.df.columns]
        return {n.lower(): n for n in names}


class Catalog:
    """Entities by name, in any case."""

    def __init__(self, entities: Iterable[Entity] = ()):
        self._by_name: dict[str, Entity] = {}
        self.uid = next(_uids)
        for e in entities:
            self.add(e)

    def add(self, entity: Entity) -> Entity:
        self._by_name[entity.name.lower()] = entity
        return entity

    def __getitem__(self, name: str) -> Entity:
        if name.lower() not in self._by_name:
            raise UnknownName(f"no entity {name!r}")
        return self._by_name[name.lower()]

    def __iter__(self):
        return iter(self._by_name.values())


def from_rows(spark: SparkSession, name: str, rows: Iterable, schema: T.StructType | str, **more) -> Entity:
    """An in-memory source; the same plans run on it."""
    return Entity(name, spark.createDataFrame(list(rows), schema), **more)


def from_parquet(spark: SparkSession, name: str, path: str, **more) -> Entity:
    return Entity(name, spark.read.parquet(path), **more)


def from_table(spark: SparkSession, name: str, table: str, **more) -> Entity:
    return Entity(name, spark.table(table), **more)


def from_jdbc(spark: SparkSession, name: str, url: str, table: str, options: dict[str, str] | None = None, json: dict[str, str] | None = None, **more) -> Entity:
    """A database table; json gives the schemas (DDL) of columns that hold JSON text.

    Reads in one task unless options hold partitionColumn, lowerBound, upperBound and numPartitions.
    """
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()
    for column, ddl in (json or {}).items():
        df = df.withColumn(column, F.from_json(column, ddl))
    return Entity(name, df, **more)


#: key, refs, collections of the star schema's tables.
_STAR: dict[str, tuple[str, tuple[str, ...], dict[str, Ref], dict[str, Coll]]] = {
    "region": ("Region", ("r_regionkey",), {}, {"Nations": Coll("Nation", "r_regionkey", "n_regionkey")}),
    "nation": (
        "Nation",
        ("n_nationkey",),
        {"Region": Ref("Region", "n_regionkey", "r_regionkey")},
        {"Customers": Coll("Customer", "n_nationkey", "c_nationkey"), "Suppliers": Coll("Supplier", "n_nationkey", "s_nationkey")},
    ),
    "customer": (
        "Customer",
        ("c_custkey",),
        {"Nation": Ref("Nation", "c_nationkey", "n_nationkey")},
        {"Orders": Coll("Order", "c_custkey", "o_custkey")},
    ),
    "supplier": (
        "Supplier",
        ("s_suppkey",),
        {"Nation": Ref("Nation", "s_nationkey", "n_nationkey")},
        {"LineItems": Coll("LineItem", "s_suppkey", "l_suppkey")},
    ),
    "part": ("Part", ("p_partkey",), {}, {"LineItems": Coll("LineItem", "p_partkey", "l_partkey")}),
    "orders": (
        "Order",
        ("o_orderkey",),
        {"Customer": Ref("Customer", "o_custkey", "c_custkey")},
        {"LineItems": Coll("LineItem", "o_orderkey", "l_orderkey")},
    ),
    "lineitem": (
        "LineItem",
        (),
        {
            "Order": Ref("Order", "l_orderkey", "o_orderkey"),
            "Part": Ref("Part", "l_partkey", "p_partkey"),
            "Supplier": Ref("Supplier", "l_suppkey", "s_suppkey"),
        },
        {},
    ),
    "events": ("Event", ("event_id",), {}, {}),
    "documents": ("Document", ("doc_id",), {}, {"Labels": Coll("Label", "doc_id", "doc_id")}),
    "labels": ("Label", ("doc_id",), {"Document": Ref("Document", "doc_id", "doc_id")}, {}),
    "embeddings": ("Embedding", ("vec_id",), {}, {}),
    "pages": ("Page", ("page_id",), {}, {}),
    "benchmark": ("Benchmark", ("item_id",), {}, {}),
    "conversations": ("Conversation", ("conv_id", "turn"), {}, {}),
}


class _Lazy(Catalog):
    """Reads a table's schema when a path first asks for it."""

    def __init__(self, make: dict[str, Callable[[], Entity]]):
        super().__init__()
        self._make = make

    def __getitem__(self, name: str) -> Entity:
        if name.lower() not in self._by_name and name.lower() in self._make:
            self.add(self._make[name.lower()]())
        return super().__getitem__(name)


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The star schema's tables under sf_dir; their scalar numbers and times are required."""

    def maker(table, name, key, refs, colls):
        def make() -> Entity:
            e = from_parquet(spark, name, f"{sf_dir}/{table}.parquet", key=key, refs=refs, colls=colls)
            valued = (T.NumericType, T.TimestampNTZType, T.TimestampType, T.DateType, T.BooleanType)
            e.required = frozenset(f.name for f in e.df.schema if isinstance(f.dataType, valued))
            return e

        return make

    return _Lazy({spec[0].lower(): maker(t, *spec) for t, spec in _STAR.items()})

"""More registered queries: structs, self references, whole navigations, members, envelopes with their pages, errors and lookups.

Imported by :mod:`.catalogue`, whose registry it fills."""

from __future__ import annotations

import asyncio

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as base
from .catalogue import _A, _BIG, _BY_CUSTOMER, _D, _F, _LATE, _O_C, _PROBE_SQL, _SQL_BIG, _SQL_F, _SQL_LATE, _add, _c, _g, _paged, _star, _where, probe
from .engine import Query, keyed_set
from .errors import LogicError
from .model import Intersection
from .plans import cache as caches
from .plans import paths
from .sources import Catalog, Coll, Entity, Ref, from_rows, from_table, star_catalog


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Owned objects: a struct column, with a struct inside.


def owned(spark: SparkSession, sf_dir: str) -> Query:
    """Orders whose status, priority and price stand in a struct; the inner one is null for every fifth order."""
    inner = F.when(F.col("o_orderkey") % 5 != 0, F.struct(F.col("o_totalprice").alias("Price"), F.col("o_orderdate").alias("Placed")))
    terms = F.struct(F.col("o_orderstatus").alias("Status"), F.col("o_orderpriority").alias("Priority"), inner.alias("Deal"))
    return Query(Catalog(), Entity("Sale", _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Id"), terms.alias("Terms")), key=("Id",)))


_OWNED = "SELECT o_orderkey AS id, o_orderstatus AS st, o_orderpriority AS pr, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS placed FROM orders"


def _sale(name: str, run, sql: str) -> None:
    _add(name, lambda s, d: run(owned(s, d)), f"WITH t AS ({_OWNED}) {sql}")


_ids = lambda q: q.df.select(F.col("Id").alias("id"))
_sale("struct_where", lambda q: _ids(q.where(_c(0, "terms.STATUS", "Enum", "Equal", "F"))), "SELECT id FROM t WHERE st = 'F'")
_sale("struct_where_inner", lambda q: _ids(q.where(_c(0, "Terms.Deal.Price", "Number", "GreaterThan", 200000))), "SELECT id FROM t WHERE price > 200000")
_sale("struct_where_null", lambda q: _ids(q.where(_c(0, "Terms.Deal.Price", "Number", "IsNull"))), "SELECT id FROM t WHERE price IS NULL")
_sale("struct_where_not_in_skips_null", lambda q: _ids(q.where(_c(0, "Terms.Deal.Price", "Number", "NotBetween", 0, 200000))), "SELECT id FROM t WHERE price NOT BETWEEN 0 AND 200000")
_sale("struct_member", lambda q: _ids(q.where(_c(0, "Terms.Deal.Placed.Year", "Number", "Equal", 1997))), "SELECT id FROM t WHERE year(placed) = 1997")
_sale("struct_order", lambda q: _ids(Query(q.catalog, q.entity, q.filter({"orders": [{"field": "Terms.Deal.Price", "direction": _D}], "page": {"pageNumber": 2, "pageSize": 25}}))), "SELECT id FROM t ORDER BY price DESC NULLS LAST, id LIMIT 25 OFFSET 25")
_sale("struct_group", lambda q: q.group({"fields": ["Terms.Status"], "aggregateBy": [{"alias": "n", "aggregator": "Count"}, {"field": "Terms.Deal.Placed", "alias": "first", "aggregator": "Minimum"}]}), "SELECT st AS TermsStatus, count(*) AS n, min(placed) AS first FROM t GROUP BY 1")
_sale("struct_select", lambda q: q.select(["Id", "Terms.Priority", "Terms.Deal.Price"]).select("Id", "Terms.Priority", "Terms.Deal.Price"), "SELECT id AS Id, pr AS Priority, price AS Price FROM t")
_sale("struct_select_dynamic", lambda q: q.select_dynamic(["Id", "Terms.Deal.Placed.Month"]).select("Id", "Terms.Deal.Placed.Month"), "SELECT id AS Id, month(placed)::INT AS Month FROM t")
_sale("struct_select_whole", lambda q: q.select(["Id", "Terms"]).select("Id", "Terms.Status", "Terms.Deal.Price"), "SELECT id AS Id, st AS Status, price AS Price FROM t")
_sale("struct_parts_win", lambda q: q.select(["Id", "Terms", "Terms.Status"]).select("Id", F.size(F.array(*[F.lit(x) for x in q.select(["Id", "Terms", "Terms.Status"]).schema["Terms"].dataType.names])).cast("long").alias("parts"), "Terms.Status"), "SELECT id AS Id, 1::BIGINT AS parts, st AS Status FROM t")


# Self references: a nation's parent has its region's number; two levels up and down.


def tree(spark: SparkSession, sf_dir: str) -> Query:
    """Nations as a hierarchy; numbers 0 to 4 have no parent."""
    n = F.col("n_nationkey")
    rows = _read(spark, sf_dir, "nation").select(n.alias("Id"), F.col("n_name").alias("Name"), F.when(n >= 15, n - 10).when(n >= 5, F.col("n_regionkey")).alias("ParentId"))
    node = Entity("Node", rows, key=("Id",), refs={"Parent": Ref("Node", "ParentId", "Id")}, colls={"Children": Coll("Node", "Id", "ParentId")})
    return Query(Catalog([node]), "Node")


_TREE = "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey >= 15 THEN n_nationkey - 10 WHEN n_nationkey >= 5 THEN n_regionkey END AS parent FROM nation"


def _node(name: str, run, sql: str) -> None:
    _add(name, lambda s, d: run(tree(s, d)), f"WITH t AS ({_TREE}) {sql}")


_node("self_reference", lambda q: _ids(q.where(_c(0, "Parent.Name", "Text", "Equal", "NATION_2"))), "SELECT t.id FROM t JOIN t AS p ON t.parent = p.id WHERE p.name = 'NATION_2'")
_node("self_reference_twice", lambda q: _ids(q.where(_c(0, "Parent.Parent.Name", "Text", "Equal", "NATION_2"))), "SELECT t.id FROM t JOIN t AS p ON t.parent = p.id JOIN t AS g ON p.parent = g.id WHERE g.name = 'NATION_2'")
_node("self_reference_null", lambda q: _ids(q.where(_c(0, "Parent.Name", "Text", "IsNull"))), "SELECT id FROM t WHERE parent IS NULL")
_node("self_collection", lambda q: _ids(q.where(_c(0, "Children.Children.Name", "Text", "IsNotNull"))), "SELECT id FROM t WHERE EXISTS (SELECT 1 FROM t AS c JOIN t AS g ON g.parent = c.id WHERE c.parent = t.id)")
_node("self_select", lambda q: q.select(["Name", "Parent.Name"]).select("Name", F.col("Parent.Name").alias("up"), F.col("Parent.Id").alias("up_id")), "SELECT t.name AS Name, p.name AS up, coalesce(p.id, 0) AS up_id FROM t LEFT JOIN t AS p ON t.parent = p.id")
_node("missing_parent_dynamic", lambda q: q.select_dynamic(["Name", "Parent"]).select("Name", F.col("Parent").isNull().alias("none")), "SELECT name AS Name, parent IS NULL AS none FROM t")
_node("missing_parent_parts_dynamic", lambda q: q.select_dynamic(["Name", "Parent.Id"]).select("Name", F.col("Parent").isNull().alias("none"), F.col("Parent.Id").alias("up")), "SELECT name AS Name, false AS none, parent AS up FROM t")
_node("missing_parent_typed", lambda q: q.select(["Name", "Parent"]).select("Name", F.col("Parent").isNull().alias("none"), F.col("Parent.Id").alias("up")), "SELECT name AS Name, false AS none, coalesce(parent, 0) AS up FROM t")
_node("self_order", lambda q: _ids(Query(q.catalog, q.entity, q.filter({"orders": [{"field": "Parent.Name"}], "page": {"pageNumber": 1, "pageSize": 8}}))), "SELECT t.id FROM t LEFT JOIN t AS p ON t.parent = p.id ORDER BY p.name NULLS FIRST, t.id LIMIT 8")
_node("self_group", lambda q: q.group({"fields": ["Parent.Name"], "aggregateBy": [{"alias": "n", "aggregator": "Count"}]}), "SELECT p.name AS ParentName, count(*) AS n FROM t LEFT JOIN t AS p ON t.parent = p.id GROUP BY 1")


# Children with nulls, and lists of lists.


def clients(spark: SparkSession, sf_dir: str) -> Query:
    """Customers with the probe's rows, which hold nulls, as a collection."""
    owner = Entity("Client", _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Id"), "c_name"), key=("Id",), colls={"Probes": Coll("Probe", "Id", "cust")})
    return Query(Catalog([owner, Entity("Probe", probe(spark, sf_dir).df, key=("id",))]), "Client")


def _client(name: str, run, sql: str) -> None:
    _add(name, lambda s, d: run(clients(s, d)), f"WITH t AS ({_PROBE_SQL}) {sql}")


_some = "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM t WHERE cust = c_custkey AND {})"
_client("any_is_null", lambda q: _ids(q.where(_c(0, "Probes.txt", "Text", "IsNull"))), _some.format("txt IS NULL"))
_client("any_is_not_null", lambda q: _ids(q.where(_c(0, "Probes.txt", "Text", "IsNotNull"))), _some.format("txt IS NOT NULL"))
_client("any_not_equal", lambda q: _ids(q.where(_c(0, "Probes.txt", "Text", "NotEqual", "5-LOW"))), _some.format("txt <> '5-LOW'"))
_client("order_coll_nullable", lambda q: _ids(Query(q.catalog, q.entity, q.filter({"orders": [{"field": "Probes.whole", "direction": _D}], "page": {"pageNumber": 1, "pageSize": 60}}))), "SELECT c_custkey AS id FROM customer LEFT JOIN (SELECT cust, max(whole) AS m FROM t GROUP BY 1) ON cust = c_custkey ORDER BY m DESC NULLS LAST, c_custkey LIMIT 60")


def nested(spark: SparkSession, sf_dir: str) -> Query:
    """Customers with their orders' quantities as arrays of structs that hold arrays of structs; some of either are empty."""
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity")).alias("Items"))
    some = F.when(F.col("o_orderkey") % 3 != 0, F.col("Items")).otherwise(F.array().cast("array<struct<l_quantity:double>>"))
    orders = _read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    orders = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", some.alias("Items"))).alias("Orders"))
    rows = _read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    empty = F.array().cast("array<struct<o_orderkey:bigint,Items:array<struct<l_quantity:double>>>>")
    return Query(Catalog(), Entity("Holder", rows.select(F.col("c_custkey").alias("Id"), F.coalesce("Orders", empty).alias("Orders")), key=("Id",)))


_NESTED = """SELECT c_custkey AS id, o_orderkey AS ok, q FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN q END AS q FROM orders JOIN (SELECT l_orderkey, {0}(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
) ON o_custkey = c_custkey"""
for _name, _how, _dir, _sort in (("min", "min", _A, "m NULLS FIRST"), ("max", "max", _D, "m DESC NULLS LAST")):
    _add(
        f"embedded_order_two_level_{_name}",
        lambda s, d, to=_dir: _ids(Query(Catalog(), Entity("Holder", nested(s, d).filter({"orders": [{"field": "Orders.Items.l_quantity", "direction": to}], "page": {"pageNumber": 1, "pageSize": 80}})))),
        f"SELECT id FROM (SELECT id, {_how}(q) AS m FROM ({_NESTED.format(_how)}) GROUP BY 1) ORDER BY {_sort}, id LIMIT 80",
    )
_add("embedded_any_two_level", lambda s, d: _ids(nested(s, d).where(_c(0, "Orders.Items.l_quantity", "Number", "Equal", 50))), "SELECT DISTINCT c_custkey AS id FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0 AND l_quantity = 50")
_add(
    "embedded_select",
    lambda s, d: nested(s, d).select(["Id", "Orders.Items.l_quantity"]).select("Id", F.size("Orders").cast("long").alias("orders"), F.aggregate("Orders", F.lit(0).cast("long"), lambda a, o: a + F.size(o["Items"])).alias("items")),
    "SELECT c_custkey AS Id, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) FILTER (o_orderkey % 3 <> 0) AS items FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)


# Whole navigations, pages of collections, defaults.

_add("select_whole_reference", _star("Order", lambda q: q.select(["o_orderkey", "Customer"]).select("o_orderkey", "Customer.c_custkey", "Customer.c_name")), "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_add(
    "select_whole_collection",
    _star("Nation", lambda q: q.select(["n_name", "Customers"]).select("n_name", F.size("Customers").cast("long").alias("n"), F.aggregate("Customers", F.lit(0).cast("long"), lambda a, c: a + c["c_custkey"]).alias("keys"))),
    "SELECT n_name, count(c_custkey) AS n, coalesce(sum(c_custkey), 0)::BIGINT AS keys FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
)
_add(
    "select_parts_win",
    _star("Order", lambda q: q.select(["o_orderkey", "Customer", "Customer.c_name"]).select("o_orderkey", "Customer.*")),
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
)
_add("select_scalar_list", _star("Embedding", lambda q: q.select(["vec_id", "embedding"]).select("vec_id", F.size("embedding").cast("long").alias("n"))), "SELECT vec_id, len(embedding) AS n FROM embeddings")
_add("select_typed_skips_members", _star("Order", lambda q: q.select(["o_orderkey", "o_orderdate.Year"]).select("*")), "SELECT o_orderkey FROM orders")
_add("select_through_reference_and_collection", _star("Order", lambda q: q.select(["o_orderkey", "Customer.Nation.Region.r_name"]).select("o_orderkey", "Customer.Nation.Region.r_name")), f"SELECT o_orderkey, r_name FROM {_O_C}")
_PAGE5 = {"selects": ["o_orderkey", "LineItems.l_quantity", "LineItems.Part.p_size"], "orders": [{"field": "o_totalprice", "direction": _D}], "page": {"pageNumber": 3, "pageSize": 5}}
_add(
    "select_collection_paged",
    _star("Order", lambda q: q.filter(_PAGE5).select("o_orderkey", F.size("LineItems").cast("long").alias("n"), F.aggregate("LineItems", F.lit(0).cast("long"), lambda a, x: a + x["Part"]["p_size"]).alias("sizes"))),
    "SELECT o_orderkey, count(l_orderkey) AS n, coalesce(sum(p_size), 0)::BIGINT AS sizes FROM (SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 5 OFFSET 10) LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
_add(
    "select_fill_defaults",
    lambda s, d: Query(Catalog(), Entity("Order", _read(s, d, "orders"), key=("o_orderkey",), defaults={"o_orderstatus": "?"})).select(["o_orderkey"], fill_defaults=True).drop("o_orderdate"),
    "SELECT o_orderkey, 0::BIGINT AS o_custkey, '?' AS o_orderstatus, 0::DOUBLE AS o_totalprice, NULL::VARCHAR AS o_orderpriority FROM orders",
)
_paged("page_overflow", "Order", [("o_orderdate", _A)], (10**9, 20), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE false")
_paged("page_deep", "LineItem", [("l_extendedprice", _A)], (10_001, 10), ["l_orderkey", "l_partkey"], "SELECT l_orderkey, l_partkey FROM lineitem ORDER BY l_extendedprice NULLS FIRST, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 10 OFFSET 100000")
_add("order_one", _star("Order", lambda q: q.order({"field": "o_totalprice", "direction": _D}).page({"pageNumber": 1, "pageSize": 12}).df.select("o_orderkey")), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 12")
_add(
    "order_list_by_sort",
    _star("Order", lambda q: q.order([{"sort": 2, "field": "o_totalprice"}, {"sort": 1, "field": "o_orderstatus", "direction": _D}]).page({"pageNumber": 2, "pageSize": 12}).df.select("o_orderkey")),
    "SELECT o_orderkey FROM orders ORDER BY o_orderstatus DESC NULLS LAST, o_totalprice NULLS FIRST, o_orderkey LIMIT 12 OFFSET 12",
)
_add("order_empty_list", _star("Region", lambda q: q.order([]).df), "SELECT * FROM region")


# Members of values.

_PARTS = {"Day": "day(ts)", "Hour": "hour(ts)", "Minute": "minute(ts)", "Second": "second(ts)", "Millisecond": "millisecond(ts) % 1000", "DayOfYear": "dayofyear(ts)", "DayOfWeek": "dayofweek(ts)", "Month": "month(ts)", "Year": "year(ts)"}
_add(
    "members_of_time",
    _star("Event", lambda q: q.select_dynamic(["event_id", *[f"ts.{p}" for p in _PARTS]]).select("event_id", *[F.col(f"ts.{p}").alias(f"x{p}") for p in _PARTS])),
    f"SELECT event_id, {', '.join(f'({sql})::INT AS x{p}' for p, sql in _PARTS.items())} FROM events",
)
_add(
    "members_of_time_others",
    _star("Event", lambda q: q.select_dynamic(["event_id", "ts.Date", "ts.TimeOfDay", "ts.Ticks", "ts.Value", "ts.HasValue"]).select("event_id", "ts.Date", "ts.TimeOfDay", "ts.Ticks", F.col("ts.Value").alias("v"), F.col("ts.HasValue").alias("has"))),
    "SELECT event_id, ts::DATE AS Date, strftime(ts, '%H:%M:%S') AS TimeOfDay, epoch_us(ts) * 10 + 621355968000000000 AS Ticks, ts AS v, true AS has FROM events",
)
for _part, _n in (("Day", 13), ("Hour", 7), ("Minute", 30), ("DayOfYear", 2)):
    _where(f"member_{_part.lower()}", "Event", _g("And", _c(0, f"ts.{_part}", "Number", "Equal", _n)), ["event_id"], f"SELECT event_id FROM events WHERE {_PARTS[_part]} = {_n}")
_where("member_date", "Event", _g("And", _c(0, "ts.Date", "Date", "GreaterThan", "2024-01-03")), ["event_id"], "SELECT event_id FROM events WHERE ts::DATE > DATE '2024-01-03'")
_add("member_has_value", lambda s, d: probe(s, d).where(_c(0, "ts.HasValue", "Boolean", "Equal", False)).df.select("id"), f"WITH t AS ({_PROBE_SQL}) SELECT id FROM t WHERE ts IS NULL")
_add("member_value_year", lambda s, d: probe(s, d).where(_c(0, "ts.Value.Year", "Number", "Equal", 1996)).df.select("id"), f"WITH t AS ({_PROBE_SQL}) SELECT id FROM t WHERE year(ts) = 1996")
_YEARS = {"Equal": ("= {0}", [1996]), "NotEqual": ("<> {0}", [1996]), "GreaterThan": ("> {0}", [1996]), "GreaterThanOrEqual": (">= {0}", [1996]), "LessThan": ("< {0}", [1996]), "LessThanOrEqual": ("<= {0}", [1996]), "Between": ("BETWEEN {0} AND {1}", [1995, 1996]), "NotBetween": ("NOT BETWEEN {0} AND {1}", [1995, 1996]), "In": ("IN ({0}, {1})", [1994, 1998]), "NotIn": ("NOT IN ({0}, {1})", [1994, 1998])}
for _op, (_shape, _values) in _YEARS.items():
    _add(
        f"member_year_{_op.lower()}",
        lambda s, d, op=_op, v=_values: probe(s, d).where(_c(0, "ts.Year", "Number", op, *v)).df.select("id"),
        f"WITH t AS ({_PROBE_SQL}) SELECT id FROM t WHERE year(ts) {_shape.format(*_values)}",
    )
_add("member_year_fraction", lambda s, d: probe(s, d).where(_c(0, "ts.Year", "Number", "GreaterThan", "1996.5")).df.select("id"), f"WITH t AS ({_PROBE_SQL}) SELECT id FROM t WHERE year(ts) > 1996.5")
for _op, _sql in (("Equal", "="), ("NotEqual", "<>")):
    _add(
        f"guid_canonical_{_op.lower()}",
        lambda s, d, op=_op: Query(Catalog(), Entity("Probe", probe(s, d).df, key=("id",), canonical_guids=frozenset({"gid"}))).where(_c(0, "gid", "Guid", op, base._GUID.upper())).df.select("id"),
        f"WITH t AS ({_PROBE_SQL}) SELECT id FROM t WHERE gid {_sql} '{base._GUID}'",
    )
_add("datetime_with_offset", lambda s, d: probe(s, d).where(_c(0, "ts", "DateTime", "GreaterThanOrEqual", "1996-06-03T02:00:00+02:00")).df.select("id"), f"WITH t AS ({_PROBE_SQL}) SELECT id FROM t WHERE ts >= TIMESTAMP '1996-06-03 00:00:00'")
_add("values_are_trimmed", lambda s, d: probe(s, d).where(_c(0, "txt", "Text", "Equal", "  5-LOW ")).df.select("id"), f"WITH t AS ({_PROBE_SQL}) SELECT id FROM t WHERE txt = '5-LOW'")
_add("values_match_literally", lambda s, d: probe(s, d).where(_g("Or", *[_c(i, "txt", "Text", "Contains", v) for i, v in enumerate(["%", "_", ".*", "' OR 1=1 --", '"'])])).df.select("id"), f"WITH t AS ({_PROBE_SQL}) SELECT id FROM t WHERE false")


# Envelopes: the page's rows with the counts beside them.

_REQUEST = {"conditionGroup": {"conditions": [_BIG]}, "selects": ["o_orderkey", "Customer.c_name"], "orders": [{"field": "o_totalprice", "direction": _D}], "page": {"pageNumber": 2, "pageSize": 7}}
_LIST_SQL = f"SELECT o_orderkey, c_name, (SELECT count(*) FROM orders WHERE {_SQL_BIG}) AS total, (SELECT ceil(count(*) / 7.0)::BIGINT FROM orders WHERE {_SQL_BIG}) AS pages FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_SQL_BIG} ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 7"


def _with_counts(r, *columns: str) -> DataFrame:
    return r.data.select(*columns, F.lit(r.total_count).cast("long").alias("total"), F.lit(r.page_count).cast("long").alias("pages"))


_two = ("o_orderkey", "Customer.c_name")
_add("filter_typed_rows", _star("Order", lambda q: q.filter(_REQUEST).select(*_two)), "SELECT o_orderkey, c_name FROM (" + _LIST_SQL + ")")
_add("filter_dynamic_rows", _star("Order", lambda q: q.filter_dynamic(_REQUEST).select(*_two)), "SELECT o_orderkey, c_name FROM (" + _LIST_SQL + ")")
_add("filter_dynamic_entity", _star("Order", lambda q: q.filter_dynamic({"conditionGroup": {"conditions": [_BIG]}})), f"SELECT * FROM orders WHERE {_SQL_BIG}")
_add("list_rows", _star("Order", lambda q: _with_counts(q.to_list(_REQUEST), *_two)), _LIST_SQL)
_add("list_dynamic_rows", _star("Order", lambda q: _with_counts(q.to_list_dynamic(_REQUEST), *_two)), _LIST_SQL)
_add("list_async_rows", _star("Order", lambda q: _with_counts(asyncio.run(q.to_list_async(_REQUEST)), *_two)), _LIST_SQL)
_add("list_dynamic_async_rows", _star("Order", lambda q: _with_counts(asyncio.run(q.to_list_dynamic_async(_REQUEST)), *_two)), _LIST_SQL)
_add("list_without_page", _star("Region", lambda q: _with_counts(q.to_list({}), "r_regionkey")), "SELECT r_regionkey, (SELECT count(*) FROM region) AS total, (SELECT count(*) FROM region) AS pages FROM region")
_SUMMARY = {"groupBy": _BY_CUSTOMER, "having": _g("And", _c(0, "n", "Number", "GreaterThan", 5)), "orders": [{"field": "top", "direction": _D}], "page": {"pageNumber": 2, "pageSize": 9}}
_GROUPS = "(SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) > 5)"
_SUMMARY_SQL = f"SELECT o_custkey, n, top, (SELECT count(*) FROM {_GROUPS}) AS total, (SELECT ceil(count(*) / 9.0)::BIGINT FROM {_GROUPS}) AS pages FROM {_GROUPS} ORDER BY top DESC, o_custkey LIMIT 9 OFFSET 9"
_add("summary_rows", _star("Order", lambda q: _with_counts(q.to_summary(_SUMMARY), "o_custkey", "n", "top")), _SUMMARY_SQL)
_add("summary_async_rows", _star("Order", lambda q: _with_counts(asyncio.run(q.to_summary_async(_SUMMARY)), "o_custkey", "n", "top")), _SUMMARY_SQL)
_SETS = {"conditionSets": [{"sort": 0, "conditionGroup": _g("And", _F)}, {"sort": 1, "intersection": "Union", "conditionGroup": _g("And", _BIG)}], "orders": [{"field": "o_totalprice", "direction": _D}], "page": {"pageNumber": 3, "pageSize": 6}}
_IN_SETS = f"(SELECT * FROM orders WHERE {_SQL_F} OR {_SQL_BIG})"
_SEGMENT_SQL = f"SELECT o_orderkey, (SELECT count(*) FROM {_IN_SETS}) AS total, (SELECT ceil(count(*) / 6.0)::BIGINT FROM {_IN_SETS}) AS pages FROM {_IN_SETS} ORDER BY o_totalprice DESC, o_orderkey LIMIT 6 OFFSET 12"
_add("segment_rows", _star("Order", lambda q: _with_counts(q.to_segment(_SETS), "o_orderkey")), _SEGMENT_SQL)
_add("segment_async_rows", _star("Order", lambda q: _with_counts(asyncio.run(q.to_segment_async(_SETS)), "o_orderkey")), _SEGMENT_SQL)
_add("segment_without_page", _star("Order", lambda q: _with_counts(q.to_segment({"conditionSets": _SETS["conditionSets"][:1]}), "o_orderkey").where("pages = 0")), f"SELECT o_orderkey, (SELECT count(*) FROM orders WHERE {_SQL_F}) AS total, 0::BIGINT AS pages FROM orders WHERE {_SQL_F}")
_EDGE = {"segment_empty_set_is_all": ([_g("And"), ("Except", _g("And", _F))], f"NOT ({_SQL_F})"), "segment_first_intersection_ignored": ([("Except", _g("And", _F)), ("Intersect", _g("And", _LATE))], f"{_SQL_F} AND {_SQL_LATE}")}
for _name, (_parts, _sql) in _EDGE.items():
    _sets = [{"sort": i, "intersection": p[0] if isinstance(p, tuple) else None, "conditionGroup": p[1] if isinstance(p, tuple) else p} for i, p in enumerate(_parts)]
    _add(_name, _star("Order", lambda q, r={"conditionSets": _sets}: q.to_segment(r).data.select("o_orderkey")), f"SELECT o_orderkey FROM orders WHERE {_sql}")
for _how, _sql in (("Except", f"SELECT o_orderkey FROM orders WHERE {_SQL_F}"), ("Intersect", "SELECT o_orderkey FROM orders WHERE false")):
    _sets = [{"sort": 0, "conditionGroup": _g("And", _F)}, {"sort": 1, "intersection": _how, "conditionGroup": _g("And", _F)}]
    _add(f"segment_select_{_how.lower()}", _star("Order", lambda q, r={"conditionSets": _sets, "selects": ["o_orderkey"]}: q.to_segment(r).data.select("o_orderkey")), _sql)
_add("segment_select_after", _star("Order", lambda q: q.to_segment({"conditionSets": [{"sort": 0, "conditionGroup": _g("And", _F)}, {"sort": 1, "intersection": "Except", "conditionGroup": _g("And", _BIG)}], "selects": ["o_orderkey"]}, select_after=True).data), f"SELECT o_orderkey FROM orders WHERE {_SQL_F} AND NOT ({_SQL_BIG})")
for _how, _sql in (("Union", "UNION"), ("Intersect", "INTERSECT"), ("Except", "EXCEPT")):
    _add(
        f"keyed_{_how.lower()}",
        lambda s, d, how=_how: keyed_set(_read(s, d, "customer").select(F.col("c_custkey").alias("k")), _read(s, d, "orders").select(F.col("o_custkey").alias("k")).where("k % 2 = 0").distinct(), ["k"], Intersection[how]),
        f"SELECT c_custkey AS k FROM customer {_sql} SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0",
    )


# In-memory rows, tables by name.


def rows_of(spark: SparkSession, sf_dir: str) -> Query:
    rows = [tuple(r) for r in _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]  # 25 rows
    return Query(Catalog(), from_rows(spark, "Nation", rows, "Id int, Name string, Region int", key=("Id",)))


_MEMORY = {"conditionGroup": {"conditions": [_c(0, "Region", "Number", "In", 1, 2)]}, "orders": [{"field": "Name"}], "page": {"pageNumber": 1, "pageSize": 4}}
_MEMORY_SQL = "SELECT n_nationkey AS Id, n_name AS Name, (SELECT count(*) FROM nation WHERE n_regionkey IN (1, 2)) AS total, (SELECT ceil(count(*) / 4.0)::BIGINT FROM nation WHERE n_regionkey IN (1, 2)) AS pages FROM nation WHERE n_regionkey IN (1, 2) ORDER BY n_name LIMIT 4"
_add("memory_list", lambda s, d: _with_counts(rows_of(s, d).to_list(_MEMORY), "Id", "Name"), _MEMORY_SQL)
_add("memory_list_dynamic", lambda s, d: _with_counts(rows_of(s, d).to_list_dynamic(_MEMORY), "Id", "Name"), _MEMORY_SQL)
_add("memory_summary", lambda s, d: _with_counts(rows_of(s, d).to_summary({"groupBy": {"fields": ["Region"], "aggregateBy": [{"alias": "n", "aggregator": "Count"}]}}), "Region", "n"), "SELECT n_regionkey AS Region, count(*) AS n, (SELECT count(DISTINCT n_regionkey) FROM nation) AS total, (SELECT count(DISTINCT n_regionkey) FROM nation) AS pages FROM nation GROUP BY 1")


def _by_name(s: SparkSession, d: str) -> DataFrame:
    _read(s, d, "part").createOrReplaceTempView("quarry_part")
    return Query(Catalog(), from_table(s, "Part", "quarry_part", key=("p_partkey",))).where(_c(0, "p_size", "Number", "LessThan", 5)).df.select("p_partkey")


_add("table_by_name", _by_name, "SELECT p_partkey FROM part WHERE p_size < 5")


# Errors and lookups as rows.


def _said(call) -> str:
    try:
        call()
    except LogicError as e:
        return str(e)
    except TypeError:
        return "null"
    return "fine"


def _agg(kind: str, field: str | None, alias: str | None = "a", fields=("o_orderstatus",), more=()) -> dict:
    return {"fields": list(fields), "aggregateBy": [{"aggregator": kind, "field": field, "alias": alias}, *more]}


#: (case, call of an order query, message)
ERRORS = [
    ("sets unique sort", lambda q: q.segment({"conditionSets": [{"sort": 1}, {"sort": 1, "intersection": "Union"}]}), "ListOfConditionsSetsMustHasUniqueSortValue"),
    ("conditions unique sort", lambda q: q.where(_g("And", _F, _LATE)), "AnyListOfConditionsMustHasUniqueSortValue"),
    ("sub groups unique sort", lambda q: q.where({"connector": "And", "subConditionGroups": [{"sort": 1}, {"sort": 1}]}), "AnyListOfSubConditionsGroupsMustHasUniqueSortValue"),
    ("required intersection", lambda q: q.segment({"conditionSets": [{"sort": 1}, {"sort": 2}]}), "ConditionsSetOfIndex[1-N]MustHasIntersection"),
    ("unknown field", lambda q: q.where(_c(0, "nope", "Text", "Equal", "x")), "ConditionMustHasValidFieldName"),
    ("blank field", lambda q: q.where(_c(0, " ", "Text", "Equal", "x")), "ConditionMustHasValidFieldName"),
    ("only dots", lambda q: q.where(_c(0, "..", "Text", "Equal", "x")), "ConditionMustHasValidFieldName"),
    ("in without values", lambda q: q.where(_c(0, "o_orderstatus", "Text", "IIn")), "ConditionWithOperator[In-IIn-NotIn-INotIn]MustHasOneOrMoreValues"),
    ("null with values", lambda q: q.where(_c(0, "o_orderstatus", "Text", "IsNotNull", 1)), "ConditionWithOperator[IsNull-IsNotNull]MustHasNoValues"),
    ("between one value", lambda q: q.where(_c(0, "o_totalprice", "Number", "NotBetween", 1)), "ConditionWithOperator[Between-NotBetween]MustHasOnlyTwoValues"),
    ("equal two values", lambda q: q.where(_c(0, "o_totalprice", "Number", "Equal", 1, 2)), "ConditionWithOperator[Equal]MustHasOnlyOneValue"),
    ("page number", lambda q: q.page({"pageNumber": 0, "pageSize": 1}), "PageNumberMustBeGreaterThanZero"),
    ("page size", lambda q: q.page({"pageNumber": 1, "pageSize": 0}), "PageSizeMustBeGreaterThanZero"),
    ("no fields", lambda q: q.select([]), "MustHasFields"),
    ("no fields, dynamic", lambda q: q.select_dynamic([]), "MustHasFields"),
    ("number format", lambda q: q.where(_c(0, "o_totalprice", "Number", "Equal", "1x")), "InvalidFormat"),
    ("guid format", lambda q: q.where(_c(0, "o_orderstatus", "Guid", "Equal", "12")), "InvalidFormat"),
    ("boolean format", lambda q: q.where(_c(0, "o_orderstatus", "Boolean", "Equal", "yes")), "InvalidFormat"),
    ("date format", lambda q: q.where(_c(0, "o_orderdate", "Date", "Equal", "last week")), "InvalidFormat"),
    ("datetime format", lambda q: q.where(_c(0, "o_orderdate", "DateTime", "Equal", "32/1/1999")), "InvalidFormat"),
    ("unsupported pair", lambda q: q.where(_c(0, "o_orderstatus", "Boolean", "GreaterThan", True)), "Unsupported combination of DataType 'Boolean' and Operator 'GreaterThan'."),
    ("alias", lambda q: q.group(_agg("Maximum", "o_totalprice", "top price")), "AggregationMustHasValidAlias"),
    ("no alias", lambda q: q.group(_agg("Count", None, None)), "AggregationMustHasValidAlias"),
    ("aggregate of a reference", lambda q: q.group(_agg("Maximum", "Customer")), "AggregationFieldMustBeSimpleType"),
    ("aggregate across a collection", lambda q: q.group(_agg("Maximum", "LineItems.l_tax")), "AggregationFieldCannotBeCollectionType"),
    ("aggregate without a field", lambda q: q.group(_agg("Minimum", None)), "ConditionMustHasValidFieldName"),
    ("sum of text", lambda q: q.group(_agg("Sumation", "o_orderpriority")), "Aggregator[Sumation]IsNotSupportedForFieldType[string]"),
    ("average of a time", lambda q: q.group(_agg("Average", "o_orderdate")), "Aggregator[Average]IsNotSupportedForFieldType[timestamp_ntz]"),
    ("maximum of a boolean", lambda q: q.group(_agg("Maximum", "o_orderdate.HasValue")), "Aggregator[Maximum]IsNotSupportedForFieldType[boolean]"),
    ("group without fields", lambda q: q.group({"fields": []}), "GroupByMustHasAtLeastOneField"),
    ("group by a field twice", lambda q: q.group({"fields": ["o_custkey", "O_CUSTKEY"]}), "GroupByFieldsMustBeUnique"),
    ("group by a reference", lambda q: q.group({"fields": ["Customer"]}), "GroupByFieldCannotBeComplexType"),
    ("group across a collection", lambda q: q.group({"fields": ["LineItems.l_tax"]}), "GroupByFieldCannotBeCollectionType"),
    ("group by a blank field", lambda q: q.group({"fields": [""]}), "ConditionMustHasValidFieldName"),
    ("aliases unique", lambda q: q.group(_agg("Count", None, "n", more=[{"aggregator": "Count", "alias": "N"}])), "AggregationAliasesMustBeUnique"),
    ("alias is a field", lambda q: q.group(_agg("Count", None, "O_OrderStatus")), "AggregationAlias[O_OrderStatus]CannotBeUsedInGroupByFields"),
    ("summary order", lambda q: q.summary({"groupBy": _BY_CUSTOMER, "orders": [{"field": "o_totalprice"}]}), "SummaryOrderField[o_totalprice]MustExistInGroupByFieldsOrAggregateByAliases"),
    ("summary order blank", lambda q: q.summary({"groupBy": _BY_CUSTOMER, "orders": [{"field": " "}]}), "ConditionMustHasValidFieldName"),
    ("summary page", lambda q: q.summary({"groupBy": _BY_CUSTOMER, "page": {"pageNumber": 0, "pageSize": 3}}), "PageNumberMustBeGreaterThanZero"),
    ("order ends on a collection", lambda q: q.order({"field": "LineItems"}), "OrderField[LineItems]CannotEndOnCollectionOfComplexElements"),
    ("order of an unknown field", lambda q: q.order({"field": "nope"}), "ConditionMustHasValidFieldName"),
    ("having of a key", lambda q: q.summary({"groupBy": _BY_CUSTOMER, "having": _g("And", _c(0, "o_custkey", "Number", "Equal", 1))}), "HavingField[o_custkey]MustExistInAggregateByAliases"),
    ("having of a blank", lambda q: q.summary({"groupBy": _BY_CUSTOMER, "having": _g("And", _c(0, "", "Number", "Equal", 1))}), "ConditionMustHasValidFieldName"),
    ("unknown operator", lambda q: q.where(_c(0, "o_orderstatus", "Text", "Resembles", "x")), "'Resembles' is no Operator"),
    ("unknown entity", lambda q: q.catalog["Nobody"], "no entity 'Nobody'"),
    ("null condition", lambda q: q.where(None), "null"),
    ("null filter", lambda q: q.filter(None), "null"),
    ("null page", lambda q: q.page(None), "null"),
    ("null order", lambda q: q.order(None), "null"),
    ("null group", lambda q: q.group(None), "null"),
    ("null select", lambda q: q.select(None), "null"),
    ("null summary", lambda q: q.summary(None), "null"),
    ("null segment", lambda q: q.to_segment(None), "null"),
    ("no group by", lambda q: q.summary({}), "null"),
    ("unicode alias", lambda q: q.group(_agg("Count", None, "Größe_2")), "fine"),
]


def _values_sql(rows: list[tuple[str, str]], a: str, b: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join(f'({quote(x)}, {quote(y)})' for x, y in rows)}) AS t({a}, {b})"


def _errors(s: SparkSession, d: str) -> DataFrame:
    catalog = star_catalog(s, d)
    return s.createDataFrame([(name, _said(lambda: call(Query(catalog, "Order")))) for name, call, _ in ERRORS], "name string, message string")


_add("errors", _errors, _values_sql([(name, message) for name, _, message in ERRORS], "name", "message"))


def _lookups(catalog: Catalog) -> list[tuple[str, str]]:
    order, c = catalog["Order"], caches.MetadataCache(caches.Options(4, caches.Strategy.LRU, 25))
    for k in "abcdabe":
        c.get(caches.Store.PropertyPath, k, lambda k=k: k)
    kept = "".join(sorted(c._stores[caches.Store.PropertyPath]))
    session = c.session()
    c.get(caches.Store.TypeProperties, "x", lambda: {})
    found = {
        "configure": c.configure(max_cache_size=8).max_cache_size,
        "configure by options": c.configure(caches.Options(4, caches.Strategy.LFU, 50)).least_used_threshold,
        "options are a copy": c.options() is not c.options(),
        "type properties": ",".join(sorted(paths.type_properties(order))),
        "find property": paths.find_property(order, "CUSTOMER"),
        "find no property": str(paths.find_property(order, "nope")),
        "is collection": paths.is_collection(catalog, order, "lineitems"),
        "is no collection": paths.is_collection(catalog, order, "customer.c_name"),
        "element type": paths.element_type(catalog, order, "LineItems").name,
        "element type of a list": paths.element_type(catalog, catalog["Embedding"], "embedding").simpleString(),
        "validated path": paths.validated_path(catalog, order, " customer . NATION.n_name "),
        "warm up": paths.warmup(catalog, "Order", "Customer.c_name", "LineItems", "nope"),
        "warm up a type": paths.warmup(catalog, order, "o_orderkey"),
        "evicts the least recently used": kept,
        "evictions": c.evictions,
        "counts": c.counts()["PropertyPath"],
        "tracking counts": c.tracking_counts()["PropertyPath"],
        "is full": c.is_full(caches.Store.PropertyPath),
        "is full by size": c.is_full(caches.Store.PropertyPath, size=9, limit=8),
        "eviction needed": c.is_eviction_needed(caches.Store.PropertyPath),
        "eviction count": c.eviction_count(10),
        "hits and misses": f"{c.hits} {c.misses}",
        "statistics": c.statistics()["total_entries"],
        "memory usage": c.memory_usage()["PropertyPath"] > 0,
        "configuration in a report": '"LFU"' in c.report() or "LFU" in c.report(),
        "compact report": c.report("compact").split(",")[0],
        "analysis report": "candidates" in c.report("analysis"),
        "health summary": c.report("summary").split(":")[0],
        "alerts": ",".join(c.alerts(0.0, 0.0))[:8],
        "monitoring": c.monitoring()["health"],
        "score": 0 < c.evaluate()["score"] <= 100,
        "session": session.changes()["total_entries"],
        "strategy": c.strategy_description(),
        "force eviction": c.force_eviction(),
        "clear one": (c.clear(caches.Store.PropertyPath), c.counts()["PropertyPath"])[1],
        "clear all": (c.clear(), sum(c.counts().values()))[1],
        "format bytes": "|".join(map(caches.format_bytes, (10, 2048, 3 * 1048576, 1 << 31))),
        "size constants": ",".join(sorted(caches.size_constants())),
        "string size": caches.string_size("abcd") - caches.string_size("") + caches.string_size(None),
    }
    return [(k, str(v)) for k, v in found.items()]


#: What the lookups and the cache answer.
LOOKUPS = {
    "configure": "8",
    "configure by options": "50",
    "options are a copy": "True",
    "type properties": "customer,lineitems,o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice",
    "find property": "Customer",
    "find no property": "None",
    "is collection": "True",
    "is no collection": "False",
    "element type": "LineItem",
    "element type of a list": "float",
    "validated path": "Customer.Nation.n_name",
    "warm up": "2",
    "warm up a type": "1",
    "evicts the least recently used": "abde",
    "evictions": "1",
    "counts": "4",
    "tracking counts": "4",
    "is full": "False",
    "is full by size": "True",
    "eviction needed": "False",
    "eviction count": "5",
    "hits and misses": "2 6",
    "statistics": "5",
    "memory usage": "True",
    "configuration in a report": "True",
    "compact report": "5 entries",
    "analysis report": "True",
    "health summary": "Healthy",
    "alerts": "critical",
    "monitoring": "Healthy",
    "score": "True",
    "session": "1",
    "strategy": "LFU: the least often used 50% go first",
    "force eviction": "3",
    "clear one": "0",
    "clear all": "0",
    "format bytes": "10 B|2.00 KB|3.00 MB|2.00 GB",
    "size constants": "dict,entry,reference,string,tuple",
    "string size": "4",
}
_add("lookups_and_cache", lambda s, d: s.createDataFrame(_lookups(star_catalog(s, d)), "name string, answer string"), _values_sql(list(LOOKUPS.items()), "name", "answer"))

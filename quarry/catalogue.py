"""Registered queries of the engine, each a JSON request, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Query
from .sources import Catalog, Entity, star_catalog

QUERIES: dict = {}
SQL: dict[str, str] = {}


# Leaf predicates: an entity over orders with a null in every column.

_PROBE_SQL = """
SELECT o_orderkey AS id, o_custkey AS cust,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS txt,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS num,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 100 END AS whole,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS flag,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS ts,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS st,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) END AS gid
FROM (SELECT *, md5(CAST(o_orderkey % 50 AS STRING)) AS h FROM orders)
"""


def probe(spark: SparkSession, sf_dir: str) -> Query:
    """Orders with derived text, number, flag, time, status and guid columns that hold nulls."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    h, key = F.md5((F.col("o_orderkey") % 50).cast("string")), F.col("o_orderkey")
    but = lambda n, c: F.when(key % n != 0, c)
    guid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    df = o.select(
        key.alias("id"),
        F.col("o_custkey").alias("cust"),
        but(7, F.col("o_orderpriority")).alias("txt"),
        but(6, F.col("o_totalprice")).alias("num"),
        but(8, key % 100).alias("whole"),
        but(9, F.col("o_orderstatus") == "F").alias("flag"),
        but(5, F.col("o_orderdate")).alias("ts"),
        but(4, F.col("o_orderstatus")).alias("st"),
        but(11, guid).alias("gid"),
    )
    return Query(Catalog(), Entity("Probe", df, key=("id",)))


def _text_sql(op: str, c: str, values: list[str]) -> str:
    negated, fold = op.startswith(("Not", "INot")), op.startswith("I") and op != "In"
    base = op.removeprefix("I" if fold else "").removeprefix("Not")
    wrap = (lambda x: f"lower({x})") if fold else (lambda x: x)
    lits = [wrap(f"'{v}'") for v in values]
    c2 = wrap(c)
    test = {
        "Equal": f"{c2} = {lits[0]}",
        "Contains": f"contains({c2}, {lits[0]})",
        "StartsWith": f"starts_with({c2}, {lits[0]})",
        "EndsWith": f"ends_with({c2}, {lits[0]})",
        "In": f"{c2} IN ({', '.join(lits)})",
    }[base]
    return f"{c} IS NOT NULL AND {'NOT ' if negated else ''}({test})"


def _ordered_sql(op: str, c: str, lits: list[str]) -> str:
    signs = {"Equal": "=", "NotEqual": "<>", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}
    if op in signs:
        return f"{c} {signs[op]} {lits[0]}"
    inside = f"{c} BETWEEN {lits[0]} AND {lits[1]}" if op.endswith("Between") else f"{c} IN ({', '.join(lits)})"
    return f"{c} IS NOT NULL AND {'NOT ' if op.startswith('Not') else ''}({inside})"


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


def _leaf(kind: str, op: str, field: str, values: list, where: str) -> None:
    request = {"field": field, "dataType": kind, "operator": op, "values": values}
    _add(
        f"where_{kind.lower()}_{op.lower()}",
        lambda s, d, r=request: probe(s, d).where(r).df.select("id"),
        f"WITH t AS ({_PROBE_SQL}) SELECT id FROM t WHERE {where}",
    )


_TEXT_VALUES = {"Equal": "5-LOW", "Contains": "I", "StartsWith": "2", "EndsWith": "M", "In": None}
for _base, _v in _TEXT_VALUES.items():
    for _prefix in ("", "I", "Not", "INot"):
        _values = ["1-URGENT", "5-LOW"] if _v is None else [_v]
        if _prefix.startswith("I"):
            _values = [x.lower() for x in _values]
        _leaf("Text", _prefix + _base, "txt", _values, _text_sql(_prefix + _base, "txt", _values))
    for _prefix in ("", "Not"):
        _values = ["F", "P"] if _v is None else ["F"]
        _leaf("Enum", _prefix + _base, "st", _values, _text_sql(_prefix + _base, "st", _values))
_GUID = "c4ca4238-a0b9-2382-0dcc-509a6f75849b"
for _op in ("Equal", "NotEqual", "In", "NotIn"):
    _values = [_GUID, "{C81E728D-9D4C-2F63-6F06-7F89CC14862C}"] if _op.endswith("In") else [_GUID.upper()]
    _leaf("Guid", _op, "gid", _values, _text_sql(_op, "gid", [x.strip("{}").lower() for x in _values]))
_NUMBERS = {"Equal": [42], "NotEqual": [42], "In": [1, 2, "3"], "NotIn": [1, 2, 3], "Between": [10, 20], "NotBetween": [10, "20"]}
for _op in ("Equal", "NotEqual", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "Between", "NotBetween", "In", "NotIn"):
    _field = "whole" if _op in _NUMBERS else "num"
    _values = _NUMBERS.get(_op, [150000.5])
    _leaf("Number", _op, _field, _values, _ordered_sql(_op, _field, [str(v) for v in _values]))
    if not _op.endswith("In"):
        for _kind, _cast in (("DateTime", "ts"), ("Date", "CAST(ts AS DATE)")):
            _values = ["1996-01-02T00:00:00", "1998-06-30T00:00:00"] if _op.endswith("Between") else ["1996-06-03T00:00:00"]
            _lits = [f"{'TIMESTAMP' if _kind == 'DateTime' else 'DATE'} '{v[:10]}'" for v in _values]
            _leaf(_kind, _op, "ts", _values, _ordered_sql(_op, _cast, _lits))
for _op in ("Equal", "NotEqual"):
    _leaf("Boolean", _op, "flag", [True], _ordered_sql(_op, "flag", ["true"]))
for _kind, _field in (("Text", "txt"), ("Guid", "gid"), ("Number", "num"), ("Boolean", "flag"), ("DateTime", "ts"), ("Date", "ts"), ("Enum", "st")):
    _leaf(_kind, "IsNull", _field, [], f"{_field} IS NULL")
    _leaf(_kind, "IsNotNull", _field, [], f"{_field} IS NOT NULL")


# Groups, navigation, order, page, projection, grouping, summaries and segments over the star schema.


def _c(sort: int, field: str, kind: str, op: str, *values) -> dict:
    return {"sort": sort, "field": field, "dataType": kind, "operator": op, "values": list(values)}


def _g(connector: str, *conditions, sub=()) -> dict:
    groups = [{**g, "sort": i} for i, g in enumerate(sub)]
    return {"connector": connector, "conditions": list(conditions), "subConditionGroups": groups}


def _star(entity: str, run):
    return lambda s, d: run(Query(star_catalog(s, d), entity))


def _where(name: str, entity: str, group: dict, keep: list[str], sql: str) -> None:
    _add(name, _star(entity, lambda q: q.where(group).df.select(*keep)), sql)


_F = _c(0, "o_orderstatus", "Enum", "Equal", "F")
_BIG = _c(1, "O_TotalPrice", "Number", "GreaterThan", 200000)
_LATE = _c(0, "o_orderdate", "Date", "GreaterThanOrEqual", "1999-01-01")
_OLD = _c(1, "o_orderpriority", "Text", "StartsWith", "1")
_SQL_F, _SQL_BIG, _SQL_LATE, _SQL_OLD = "o_orderstatus = 'F'", "o_totalprice > 200000", "CAST(o_orderdate AS DATE) >= DATE '1999-01-01'", "starts_with(o_orderpriority, '1')"
_where("group_and", "Order", _g("And", _F, _BIG), ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE {_SQL_F} AND {_SQL_BIG}")
_where("group_or", "Order", _g("Or", _F, _BIG), ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE {_SQL_F} OR {_SQL_BIG}")
_where("group_nested", "Order", _g("And", _F, sub=[_g("Or", _LATE, _OLD)]), ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE {_SQL_F} AND ({_SQL_LATE} OR {_SQL_OLD})")
_where("group_deep", "Order", _g("Or", _BIG, sub=[_g("And", _F, sub=[_g("Or", _LATE, _OLD)])]), ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE {_SQL_BIG} OR ({_SQL_F} AND ({_SQL_LATE} OR {_SQL_OLD}))")
_where("group_empty", "Region", _g("And"), ["r_regionkey"], "SELECT r_regionkey FROM region")

_O_C = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_where("nav_reference_1", "Order", _g("And", _c(0, "Customer.c_acctbal", "Number", "LessThan", 0)), ["o_orderkey"], f"SELECT o_orderkey FROM {_O_C} WHERE c_acctbal < 0")
_where("nav_reference_2", "Order", _g("And", _c(0, "Customer.Nation.n_nationkey", "Number", "In", 1, 3)), ["o_orderkey"], f"SELECT o_orderkey FROM {_O_C} WHERE n_nationkey IN (1, 3)")
_where("nav_reference_3", "Order", _g("And", _c(0, "customer.nation.region.r_regionkey", "Number", "Equal", 2)), ["o_orderkey"], f"SELECT o_orderkey FROM {_O_C} WHERE r_regionkey = 2")
_RETURNED = "l_returnflag = 'R'"
_HAS = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {})"
_where("nav_any_1", "Order", _g("And", _c(0, "LineItems.l_quantity", "Number", "GreaterThan", 49)), ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE {_HAS.format('l_quantity > 49')}")
_where("nav_any_2", "Customer", _g("And", _c(0, "Orders.LineItems.l_discount", "Number", "GreaterThan", "0.09")), ["c_custkey"], "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_discount > 0.09)")
_where("nav_any_under_or", "Order", _g("Or", _c(0, "LineItems.l_quantity", "Number", "GreaterThan", 49), _BIG), ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE {_HAS.format('l_quantity > 49')} OR {_SQL_BIG}")
_where("nav_any_two_conditions", "Order", _g("And", _c(0, "LineItems.l_quantity", "Number", "GreaterThan", 45), _c(1, "LineItems.l_returnflag", "Text", "Equal", "R")), ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE {_HAS.format('l_quantity > 45')} AND {_HAS.format(_RETURNED)}")
_where("nav_any_then_reference", "Order", _g("And", _c(0, "LineItems.Part.p_size", "Number", "Equal", 7)), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size = 7)")
_where("member_year", "Order", _g("And", _c(0, "o_orderdate.Year", "Number", "Equal", 1997)), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997")
_where("member_dayofweek", "Order", _g("And", _c(0, "o_orderdate.DayOfWeek", "Number", "Equal", 0)), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE dayofweek(o_orderdate) = 0")
_where("member_length", "Part", _g("And", _c(0, "p_name.Length", "Number", "GreaterThan", 10)), ["p_partkey"], "SELECT p_partkey FROM part WHERE length(p_name) > 10")


def _paged(name: str, entity: str, orders: list[tuple[str, str]], page: tuple[int, int], keep: list[str], sql: str) -> None:
    request = {
        "orders": [{"sort": i, "field": f, "direction": d} for i, (f, d) in enumerate(orders)],
        "page": {"pageNumber": page[0], "pageSize": page[1]},
    }
    _add(name, _star(entity, lambda q: q.filter(request).select(*keep)), sql)


_A, _D = "Ascending", "Descending"
_paged("order_scalar", "Order", [("o_totalprice", _D)], (1, 50), ["o_orderkey"], "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
_paged("order_multi", "Order", [("o_orderstatus", _A), ("o_orderdate", _D)], (1, 40), ["o_orderkey"], "SELECT o_orderkey FROM orders ORDER BY o_orderstatus NULLS FIRST, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 40")
_paged("order_reference", "Order", [("Customer.c_name", _A)], (2, 30), ["o_orderkey"], f"SELECT o_orderkey FROM {_O_C} ORDER BY c_name NULLS FIRST, o_orderkey LIMIT 30 OFFSET 30")
_MIN = "LEFT JOIN (SELECT l_orderkey, {f}(l_extendedprice) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"
_paged("order_coll_min", "Order", [("LineItems.l_extendedprice", _A)], (1, 300), ["o_orderkey"], f"SELECT o_orderkey FROM orders {_MIN.format(f='min')} ORDER BY coalesce(k, 0), o_orderkey LIMIT 300")
_paged("order_coll_max", "Order", [("LineItems.l_extendedprice", _D)], (1, 30), ["o_orderkey"], f"SELECT o_orderkey FROM orders {_MIN.format(f='max')} ORDER BY coalesce(k, 0) DESC, o_orderkey LIMIT 30")
_paged("order_coll_text", "Order", [("LineItems.l_returnflag", _A)], (1, 300), ["o_orderkey"], "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY k NULLS FIRST, o_orderkey LIMIT 300")
_paged("order_coll_two_level", "Customer", [("Orders.LineItems.l_quantity", _A)], (1, 400), ["c_custkey"], "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, min(coalesce(k, 0)) AS m FROM orders LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey ORDER BY coalesce(m, 0), c_custkey LIMIT 400")
_paged("order_scalar_array", "Embedding", [("embedding", _D)], (1, 25), ["vec_id"], "SELECT vec_id FROM embeddings ORDER BY list_max(embedding) DESC, vec_id LIMIT 25")
for _n, _p in (("first", 1), ("second", 2), ("beyond", 10**6)):
    _paged(f"page_{_n}", "Order", [("o_orderdate", _A)], (_p, 20), ["o_orderkey"], f"SELECT o_orderkey FROM orders ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 20 OFFSET {20 * (_p - 1)}")

_add("select_scalars", _star("Order", lambda q: q.select(["o_orderkey", "O_ORDERSTATUS"])), "SELECT o_orderkey, o_orderstatus FROM orders")
_add(
    "select_nested_reference",
    _star("Order", lambda q: q.select(["o_orderkey", "Customer.c_name", "Customer.Nation.n_name"]).select("o_orderkey", "Customer.c_name", "Customer.Nation.n_name")),
    f"SELECT o_orderkey, c_name, n_name FROM {_O_C}",
)
_add(
    "select_collection",
    _star(
        "Order",
        lambda q: q.select(["o_orderkey", "LineItems.l_quantity"]).select(
            "o_orderkey", F.size("LineItems").cast("long").alias("n"), F.aggregate("LineItems", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("q")
        ),
    ),
    "SELECT o_orderkey, count(l_orderkey) AS n, coalesce(sum(l_quantity), 0) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
_add(
    "select_dynamic",
    _star("LineItem", lambda q: q.select_dynamic(["l_quantity", "Part.p_size", "Part.p_brand"]).select("l_quantity", "Part.p_size", "Part.p_brand")),
    "SELECT l_quantity, p_size, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey",
)
_add(
    "select_dynamic_collection",
    _star("Nation", lambda q: q.select_dynamic(["n_name", "Customers.Orders.o_orderkey"]).select("n_name", F.aggregate("Customers", F.lit(0).cast("long"), lambda a, c: a + F.size(c["Orders"])).alias("n"))),
    "SELECT n_name, count(o_orderkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)


def _group(name: str, entity: str, fields: list[str], aggregates: list[tuple], sql: str) -> None:
    request = {"fields": fields, "aggregateBy": [{"field": f, "alias": a, "aggregator": k} for k, f, a in aggregates]}
    _add(name, _star(entity, lambda q: q.group(request)), sql)


_BY = "FROM orders GROUP BY o_orderstatus"
_group("agg_count", "Order", ["o_orderstatus"], [("Count", None, "n")], f"SELECT o_orderstatus, count(*) AS n {_BY}")
_group("agg_countdistinct", "Order", ["o_orderstatus"], [("CountDistinct", "o_custkey", "n")], f"SELECT o_orderstatus, count(DISTINCT o_custkey) AS n {_BY}")
_group("agg_sumation", "Order", ["o_orderstatus"], [("Sumation", "o_orderkey", "s")], f"SELECT o_orderstatus, sum(o_orderkey)::BIGINT AS s {_BY}")
_group("agg_average", "LineItem", ["l_returnflag"], [("Average", "l_linenumber", "a")], "SELECT l_returnflag, avg(l_linenumber) AS a FROM lineitem GROUP BY 1")
_group("agg_minimum", "Order", ["o_orderstatus"], [("Minimum", "o_orderdate", "m")], f"SELECT o_orderstatus, min(o_orderdate) AS m {_BY}")
_group("agg_maximum", "Order", ["o_orderstatus"], [("Maximum", "o_totalprice", "m")], f"SELECT o_orderstatus, max(o_totalprice) AS m {_BY}")
_group("agg_first", "Order", ["o_orderstatus"], [("FirstOrDefault", "o_orderpriority", "f")], f"SELECT o_orderstatus, min(o_orderpriority) AS f {_BY}")
_group("agg_last", "Order", ["o_orderstatus"], [("LastOrDefault", "o_orderpriority", "f")], f"SELECT o_orderstatus, max(o_orderpriority) AS f {_BY}")
_add(
    "agg_first_null",
    lambda s, d: probe(s, d).group({"fields": ["flag"], "aggregateBy": [{"field": "whole", "alias": "f", "aggregator": "FirstOrDefault"}, {"field": "whole", "alias": "l", "aggregator": "LastOrDefault"}]}),
    f"WITH t AS ({_PROBE_SQL}) SELECT flag, CASE WHEN count(whole) = count(*) THEN min(whole) END AS f, max(whole) AS l FROM t GROUP BY flag",
)
_group("group_multi", "LineItem", ["l_returnflag", "l_linestatus"], [("Count", None, "n"), ("Sumation", "l_linenumber", "s")], "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1, 2")
_group("group_dotted_key", "Order", ["Customer.c_mktsegment"], [("Count", None, "n")], "SELECT c_mktsegment AS Customerc_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
_group("group_date_part", "Order", ["o_orderdate.Year", "o_orderdate.Month"], [("Count", None, "n")], "SELECT year(o_orderdate)::INT AS o_orderdateYear, month(o_orderdate)::INT AS o_orderdateMonth, count(*) AS n FROM orders GROUP BY 1, 2")
_group("group_keys_only", "Order", ["o_orderstatus", "o_orderpriority"], [], "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


def _summary(name: str, entity: str, request: dict, sql: str) -> None:
    _add(name, _star(entity, lambda q: q.summary(request)), sql)


_BY_CUSTOMER = {"fields": ["o_custkey"], "aggregateBy": [{"alias": "n", "aggregator": "Count"}, {"field": "o_totalprice", "alias": "top", "aggregator": "Maximum"}]}
_SUM = "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders"
_summary("having_simple", "Order", {"groupBy": _BY_CUSTOMER, "having": _g("And", _c(0, "N", "Number", "GreaterThan", 12))}, f"{_SUM} GROUP BY 1 HAVING count(*) > 12")
_summary("having_and", "Order", {"groupBy": _BY_CUSTOMER, "having": _g("And", _c(0, "n", "Number", "GreaterThan", 5), _c(1, "top", "Number", "LessThan", 300000))}, f"{_SUM} GROUP BY 1 HAVING count(*) > 5 AND max(o_totalprice) < 300000")
_summary("having_nested", "Order", {"groupBy": _BY_CUSTOMER, "having": _g("Or", _c(0, "n", "Number", "GreaterThan", 15), sub=[_g("And", _c(0, "n", "Number", "LessThan", 4), _c(1, "top", "Number", "GreaterThan", 200000))])}, f"{_SUM} GROUP BY 1 HAVING count(*) > 15 OR (count(*) < 4 AND max(o_totalprice) > 200000)")
_summary(
    "summary_full_pipeline",
    "Order",
    {
        "conditionGroup": _g("And", _c(0, "o_orderstatus", "Enum", "NotEqual", "P")),
        "groupBy": {"fields": ["Customer.Nation.n_name", "o_orderstatus"], "aggregateBy": [{"alias": "n", "aggregator": "Count"}, {"field": "o_custkey", "alias": "customers", "aggregator": "CountDistinct"}]},
        "having": _g("And", _c(0, "n", "Number", "GreaterThanOrEqual", 10)),
        "orders": [{"sort": 1, "field": "Customer.Nation.n_name"}, {"sort": 0, "field": "n", "direction": _D}],
        "page": {"pageNumber": 1, "pageSize": 15},
    },
    f"SELECT n_name AS CustomerNationn_name, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM {_O_C} WHERE o_orderstatus <> 'P' GROUP BY 1, 2 HAVING count(*) >= 10 ORDER BY n DESC, 1, 2 LIMIT 15",
)


def _segment(name: str, sets: list[tuple[int, str | None, dict]], sql: str, **more) -> None:
    request = {"conditionSets": [{"sort": s, "intersection": i, "conditionGroup": g} for s, i, g in sets], **more}
    _add(name, _star("Order", lambda q: q.to_segment(request).data.select("o_orderkey")), sql)


_PF, _PB, _PL = _g("And", _F), _g("And", _BIG), _g("And", _LATE)
_segment("segment_union", [(0, None, _PF), (1, "Union", _PB)], f"SELECT o_orderkey FROM orders WHERE {_SQL_F} OR {_SQL_BIG}")
_segment("segment_intersect", [(0, None, _PF), (1, "Intersect", _PB)], f"SELECT o_orderkey FROM orders WHERE {_SQL_F} AND {_SQL_BIG}")
_segment("segment_except", [(0, None, _PF), (1, "Except", _PB)], f"SELECT o_orderkey FROM orders WHERE {_SQL_F} AND NOT ({_SQL_BIG})")
_segment("segment_union_then_except", [(0, None, _PF), (1, "Union", _PB), (2, "Except", _PL)], f"SELECT o_orderkey FROM orders WHERE ({_SQL_F} OR {_SQL_BIG}) AND NOT ({_SQL_LATE})")
_segment("segment_sort_order", [(2, "Except", _PL), (0, "Intersect", _PF), (1, "Union", _PB)], f"SELECT o_orderkey FROM orders WHERE ({_SQL_F} OR {_SQL_BIG}) AND NOT ({_SQL_LATE})")
_segment("segment_any_except", [(0, None, _PF), (1, "Except", _g("And", _c(0, "LineItems.l_quantity", "Number", "GreaterThan", 45)))], f"SELECT o_orderkey FROM orders WHERE {_SQL_F} AND NOT {_HAS.format('l_quantity > 45')}")
_segment("segment_zero_sets", [], "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10", orders=[{"sort": 0, "field": "o_orderkey", "direction": _D}], page={"pageNumber": 1, "pageSize": 10})
_segment("segment_paged", [(0, None, _PF), (1, "Union", _PB)], f"SELECT o_orderkey FROM orders WHERE {_SQL_F} OR {_SQL_BIG} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10", orders=[{"sort": 0, "field": "o_totalprice", "direction": _D}], page={"pageNumber": 2, "pageSize": 10})
_segment("segment_select_union", [(0, None, _PF), (1, "Union", _PB)], f"SELECT o_orderkey FROM orders WHERE {_SQL_F} UNION ALL SELECT o_orderkey FROM orders WHERE {_SQL_BIG}", selects=["o_orderkey"])


def _envelope(name: str, entity: str, run, sql: str) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        r = run(Query(star_catalog(s, d), entity))
        return s.createDataFrame([(r.total_count, r.page_number, r.page_size, r.page_count)], "total long, number long, size long, pages long")

    _add(name, query, sql)


_HEAD = "SELECT count(*) AS total, 2::BIGINT AS number, 7::BIGINT AS size, ceil(count(*) / 7.0)::BIGINT AS pages FROM"
_P2 = {"pageNumber": 2, "pageSize": 7}
_envelope("envelope_filter", "Order", lambda q: q.to_list({"conditionGroup": _PB, "page": _P2}), f"{_HEAD} orders WHERE {_SQL_BIG}")
_envelope("envelope_summary", "Order", lambda q: q.to_summary({"groupBy": _BY_CUSTOMER, "page": _P2}), f"{_HEAD} (SELECT DISTINCT o_custkey FROM orders)")
_envelope("envelope_segment", "Order", lambda q: q.to_segment({"conditionSets": [{"conditionGroup": _PB}], "page": _P2}), f"{_HEAD} orders WHERE {_SQL_BIG}")

_add(
    "flagship",
    _star(
        "Order",
        lambda q: q.filter(
            {
                "conditionGroup": _g("And", _F, _c(1, "o_totalprice", "Number", "GreaterThan", 100000)),
                "selects": ["o_orderkey", "o_totalprice", "o_orderdate"],
                "orders": [{"sort": 0, "field": "o_totalprice", "direction": _D}, {"sort": 1, "field": "o_orderkey"}],
                "page": {"pageNumber": 1, "pageSize": 10},
            }
        ),
    ),
    "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)


def embedded(spark: SparkSession, sf_dir: str) -> Query:
    """Orders with their line items as an array of structs, grouped by key."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    items = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("Items"))
    return Query(Catalog(), Entity("Basket", items, key=("l_orderkey",)))


_add("embedded_any", lambda s, d: embedded(s, d).where(_c(0, "Items.l_quantity", "Number", "GreaterThan", 49)).df.select("l_orderkey"), "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49")
_add(
    "embedded_order",
    lambda s, d: embedded(s, d).filter({"orders": [{"field": "Items.l_quantity", "direction": _D}], "page": {"pageNumber": 1, "pageSize": 30}}).select("l_orderkey"),
    "SELECT l_orderkey FROM lineitem GROUP BY 1 ORDER BY max(l_quantity) DESC, 1 LIMIT 30",
)
_add(
    "scalar_array_contains",
    lambda s, d: Query(Catalog(), Entity("Doc", s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.split("o_orderpriority", "-").alias("parts")), key=("o_orderkey",))).where(_c(0, "parts", "Text", "Contains", "LOW")).df.select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE list_contains(string_split(o_orderpriority, '-'), 'LOW')",
)


from . import catalogue_shapes  # noqa: E402, F401  registers the rest

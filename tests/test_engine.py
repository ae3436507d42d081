"""Golden results over a small sales domain, validation messages and catalogue spot checks."""

import asyncio
from decimal import Decimal

import pytest

from quarry import errors as E
from quarry.model import Filter, Operator
from quarry.operators.grouping import is_identifier
from quarry.operators.predicates import PAIRS
from quarry.plans.cache import MetadataCache, Options, Store, Strategy
from shop import _id, sales


@pytest.fixture(scope="module")
def shop(spark):
    return sales(spark)


def cond(field, kind, op, *values, sort=0):
    return {"sort": sort, "field": field, "dataType": kind, "operator": op, "values": list(values)}


def test_all_pairs_are_there():
    kinds = {k for k, _ in PAIRS}
    assert len(PAIRS) + 2 * len(kinds) == 76 and {o for _, o in PAIRS} | {"IsNull", "IsNotNull"} == {o.value for o in Operator}


@pytest.mark.parametrize(
    "c, n",
    [
        (cond("Name", "Text", "Contains", "Pro"), 3), (cond("Name", "Text", "NotContains", "Pro"), 5), (cond("name", "Text", "Equal", " Pro "), 1),
        (cond("Name", "Text", "NotEqual", "Pro"), 7), (cond("Name", "Text", "StartsWith", "Pro"), 2), (cond("Name", "Text", "EndsWith", "Pro"), 2),
        (cond("Name", "Text", "IContains", "pro"), 5), (cond("Name", "Text", "IEndsWith", "pro"), 4), (cond("Name", "Text", "INotIn", "pro", "ultra"), 5),
        (cond("Description", "Text", "NotContains", "a"), 3), (cond("Description", "Text", "IsNull"), 3), (cond("Price", "Number", "Between", 20, "200"), 3),
        (cond("Price", "Number", "NotBetween", 20, 200), 5), (cond("StockQuantity", "Number", "In", 0, 10, 50, 100), 5), (cond("IsActive", "Boolean", "NotEqual", True), 2),
        (cond("CreatedAt", "DateTime", "GreaterThanOrEqual", "2024-01-01"), 4), (cond("UpdatedAt", "DateTime", "IsNotNull"), 5), (cond("CategoryId", "Guid", "IsNull"), 1),
        (cond("Category.Name", "Text", "Equal", "Smartphones"), 2), (cond("Category.ParentCategory.Name", "Text", "Equal", "Electronics"), 4),
        (cond("Tags", "Text", "Contains", "laptop"), 2), (cond("OrderItems.Order.OrderNumber", "Text", "Equal", "ORD-1004"), 2), (cond("Name.Length", "Number", "LessThan", 4), 2),
    ],
)
def test_leaf_goldens(shop, c, n):
    assert shop("Product").where(c).df.count() == n


@pytest.mark.parametrize("value", ["%", "_", ".*", "$1", "`x`", 'qu"ote', "back\\slash", "' OR 1=1 --"])
def test_values_match_literally(shop, value):
    assert shop("Product").where(cond("Name", "Text", "Contains", value)).df.count() == 0


@pytest.mark.parametrize(
    "c, message",
    [
        (cond("Nope", "Text", "Equal", "x"), E.INVALID_FIELD), (cond("..", "Text", "Equal", "x"), E.INVALID_FIELD), (cond("Price", "Number", "Equal", "abc"), E.INVALID_FORMAT),
        (cond("Price", "Number", "Between", 1), E.REQUIRED_TWO_VALUE), (cond("Name", "Text", "In"), E.REQUIRED_VALUES), (cond("Name", "Text", "IsNull", 1), E.NOT_REQUIRED_VALUES),
        (cond("Name", "Text", "Equal"), E.required_one_value("Equal")), (cond("Name", "Text", "GreaterThan", "a"), "Unsupported combination of DataType 'Text' and Operator 'GreaterThan'."),
    ],
)
def test_condition_errors(shop, c, message):
    with pytest.raises(E.LogicError, match="^" + __import__("re").escape(message) + "$"):
        shop("Product").where(c)


def names(df):
    return [r[0] for r in df.select("Name").collect()]


def test_orders_and_pages(shop):
    p = shop("Product")
    assert names(p.filter({"orders": [{"field": "Name"}]})) == ["Basic", "Gadget pro", "Laptop Pro", "Pro", "ProBook", "Ultra", "Widget", "pro"]
    by = [{"sort": 2, "field": "Name"}, {"sort": 1, "field": "Category.Name", "direction": "Descending"}]
    assert names(p.filter({"orders": by})) == ["Pro", "pro", "Laptop Pro", "ProBook", "Gadget pro", "Ultra", "Basic", "Widget"]
    assert names(p.filter({"orders": [{"field": "Price"}], "page": {"pageNumber": 2, "pageSize": 3}})) == ["Ultra", "Pro", "Laptop Pro"]
    up = shop("Order").filter({"orders": [{"field": "OrderItems.UnitPrice"}]}).select("OrderNumber").collect()
    assert [r[0][-4:] for r in up] == ["1005", "1003", "1006", "1004", "1001", "1002"]
    down = shop("Order").filter({"orders": [{"field": "OrderItems.UnitPrice", "direction": 1}]}).select("OrderNumber").collect()
    assert [r[0][-4:] for r in down] == ["1002", "1004", "1001", "1006", "1003", "1005"]
    with pytest.raises(E.LogicError, match="CannotEndOnCollectionOfComplexElements"):
        shop("Order").order({"field": "OrderItems"})
    with pytest.raises(E.LogicError, match=E.INVALID_PAGE_SIZE):
        p.page({"pageNumber": 1, "pageSize": 0})


def test_projections(shop):
    rows = {r.Name: r for r in shop("Product").filter({"selects": ["Name", "Category.Name"]}).collect()}
    assert rows["Pro"].Category.Name == "Smartphones" and rows["Pro"].Category.Id == _id(102)
    assert rows["Widget"].Category is not None and rows["Widget"].Category.Name is None
    dynamic = {r.Name: r for r in shop("Product").select_dynamic(["Name", "Category.Name"]).collect()}
    assert dynamic["Pro"].Category.__fields__ == ["Name"] and dynamic["Widget"].Category.Name is None
    items = {r.OrderNumber: r.OrderItems for r in shop("Order").select(["OrderNumber", "OrderItems.UnitPrice"]).collect()}
    assert items["ORD-1005"] == [] and len(items["ORD-1001"]) == 2
    ordered = shop("Product").filter({"selects": ["Name", "Category.Name"], "orders": [{"field": "Price"}], "page": {"pageNumber": 1, "pageSize": 3}})
    assert names(ordered) == ["Widget", "Basic", "pro"]
    with pytest.raises(E.LogicError, match=E.MUST_HAVE_FIELDS):
        shop("Product").select([])


def test_groups_and_summaries(shop):
    by = {"fields": ["IsActive"], "aggregateBy": [{"alias": "n", "aggregator": "Count"}, {"field": "Price", "alias": "s", "aggregator": "Sumation"}, {"field": "Name", "alias": "f", "aggregator": "FirstOrDefault"}, {"field": "Name", "alias": "l", "aggregator": 7}]}
    got = {r.IsActive: r for r in shop("Product").group(by).collect()}
    assert (got[True].n, got[True].s, got[True].f, got[True].l) == (6, Decimal("1826.49"), "Gadget pro", "pro")
    r = shop("Product").to_summary({"groupBy": by, "having": {"conditions": [cond("n", "Number", "GreaterThan", 2)]}, "orders": [{"field": "n"}]}, query_string=True)
    assert r.total_count == 1 and r.page_count == 1 and "Aggregate" in r.query_string
    with pytest.raises(E.LogicError, match="HavingField"):
        shop("Product").summary({"groupBy": by, "having": {"conditions": [cond("IsActive", "Boolean", "Equal", True)]}})
    with pytest.raises(E.LogicError, match="SummaryOrderField"):
        shop("Product").summary({"groupBy": by, "orders": [{"field": "Price"}]})
    with pytest.raises(TypeError):
        shop("Product").summary({})
    for fields, message in (([], E.GROUP_BY_FIELDS), (["Name", "name"], E.GROUP_BY_UNIQUE), (["Category"], E.GROUP_BY_COMPLEX), (["OrderItems"], E.GROUP_BY_COMPLEX), (["Tags"], E.GROUP_BY_COLLECTION)):
        with pytest.raises(E.LogicError, match=message):
            shop("Product").group({"fields": fields})


def test_segments(shop):
    sets = lambda *parts: [{"sort": i, "intersection": k, "conditionGroup": {"conditions": [c]}} for i, (k, c) in enumerate(parts)]
    a, b, c = cond("IsActive", "Boolean", "Equal", True), cond("Price", "Number", "GreaterThan", 100), cond("StockQuantity", "Number", "Equal", 0)
    n = lambda *parts, **more: shop("Product").to_segment({"conditionSets": sets(*parts), **more})
    assert [n((None, a), (k, b)).total_count for k in ("Union", "Intersect", "Except")] == [7, 3, 3]
    assert n((None, a), ("Union", b), ("Except", c)).total_count == 5 and n((None, a)).page_count == 0
    assert n((None, a), ("Intersect", b), selects=["Name"]).total_count == 0 and n((None, a), ("Union", b), selects=["Name"]).total_count == 10
    with pytest.raises(E.LogicError, match="ConditionsSetOfIndex"):
        n((None, a), (None, b))
    page = n((None, a), ("Union", b), orders=[{"field": "Price", "direction": "Descending"}], page={"pageNumber": 1, "pageSize": 3})
    assert names(page.data) == ["ProBook", "Gadget pro", "Laptop Pro"] and page.page_count == 3


def test_envelopes(shop):
    f = {"conditionGroup": {"conditions": [cond("IsActive", "Boolean", "Equal", True)]}, "orders": [{"field": "Price"}], "page": {"pageNumber": 1, "pageSize": 4}}
    r = asyncio.run(shop("Product").to_list_async(f))
    assert (r.total_count, r.page_count) == (6, 2) and names(r.data) == ["Widget", "pro", "Ultra", "Pro"]
    r = shop("Product").to_list({})
    assert (r.page_number, r.page_size, r.page_count) == (0, 0, 8) and '"Description":null' in r.to_json()
    assert Filter.from_json('{"CONDITIONGROUP": {"Connector": 1, "Conditions": []}}').condition_group.connector.value == "Or"


def test_aliases():
    assert all(map(is_identifier, ["n", "_n", "sum_of_2", "Größe", "合計"]))
    assert not any(map(is_identifier, ["a, b", "a b", "a-b", "a.b", "2a", "a)", "", " ", None]))


def test_cache():
    for strategy, gone in ((Strategy.FIFO, "a"), (Strategy.LRU, "b"), (Strategy.LFU, "b")):
        cache = MetadataCache(Options(2, strategy, 25))
        for k in ("a", "b", "a", "a", "c"):
            cache.get(Store.PropertyPath, k, lambda k=k: k)
        kept = cache.counts()["PropertyPath"]
        assert kept == 2 and cache.evictions == 1, strategy
        assert gone not in cache._stores[Store.PropertyPath]
    assert Options.preset("low_memory").most_used_threshold == 60 and cache.health() in ("Healthy", "Warning")
    assert 0 <= cache.evaluate()["score"] <= 100 and cache.report("compact") and cache.session().changes()
    with pytest.raises(ValueError):
        Options(0)

"""A small sales domain for tests."""

from datetime import datetime
from decimal import Decimal

from quarry.engine import Query
from quarry.sources import Catalog, Coll, Ref, from_rows


def _id(n):
    return f"{n:08x}-0000-0000-0000-000000000000"


def sales(spark):
    """A function from an entity's name to its query."""
    day = lambda s: datetime.fromisoformat(s) if s else None
    # A small sales domain, whose results are golden.
    product = [
        (201, "Pro", "Main phone", "150.00", 4.5, 10, True, "2024-03-01", "2024-06-01", ["radio", "top"], 102),
        (202, "pro", None, "45.50", 3.5, 0, True, "2023-05-10", None, ["small"], 102),
        (203, "ProBook", "Laptop for work", "999.99", 4.8, 5, True, "2024-01-15", "2024-07-20", ["laptop"], 103),
        (204, "Laptop Pro", None, "250.00", 2.5, 50, False, "2022-11-05", None, ["laptop"], 103),
        (205, "Ultra", "Middle shelf one", "75.25", 4.0, 100, True, "2024-02-20", "2024-05-15", ["middle"], 101),
        (206, "Basic", "For beginners", "19.99", 1.5, 250, False, "2023-08-30", None, [], 104),
        (207, "Widget", "Fits to others", "5.00", 3.5, 1, True, "2025-01-10", "2025-02-01", ["part"], None),
        (208, "Gadget pro", None, "550.75", 5.0, 0, True, "2023-02-14", "2024-01-01", ["extra"], 101),
    ]
    rows = [(_id(p[0]), *p[1:3], Decimal(p[3]), *p[4:7], day(p[7]), day(p[8]), p[9], p[10] and _id(p[10])) for p in product]
    schema = "Id string, Name string, Description string, Price decimal(18,2), Rating double, StockQuantity int, IsActive boolean, CreatedAt timestamp_ntz, UpdatedAt timestamp_ntz, Tags array<string>, CategoryId string"
    category = [(_id(101), "Electronics", None), (_id(102), "Smartphones", _id(101)), (_id(103), "Laptops", _id(101)), (_id(104), "Clearance", None)]
    item = [(501, 401, 201, "150.00"), (502, 401, 205, "75.25"), (503, 402, 203, "999.99"), (504, 403, 207, "5.00"), (505, 404, 208, "550.75"), (506, 404, 202, "45.50"), (507, 406, 206, "19.99")]
    order = [(401, "ORD-1001"), (402, "ORD-1002"), (403, "ORD-1003"), (404, "ORD-1004"), (405, "ORD-1005"), (406, "ORD-1006")]
    catalog = Catalog(
        [
            from_rows(spark, "Product", rows, schema, key=("Id",), refs={"Category": Ref("Category", "CategoryId", "Id")}, colls={"OrderItems": Coll("OrderItem", "Id", "ProductId")}),
            from_rows(spark, "Category", category, "Id string, Name string, ParentCategoryId string", key=("Id",), refs={"ParentCategory": Ref("Category", "ParentCategoryId", "Id")}, colls={"Products": Coll("Product", "Id", "CategoryId")}),
            from_rows(spark, "Order", [(_id(a), b) for a, b in order], "Id string, OrderNumber string", key=("Id",), colls={"OrderItems": Coll("OrderItem", "Id", "OrderId")}),
            from_rows(spark, "OrderItem", [(_id(a), _id(b), _id(c), Decimal(d)) for a, b, c, d in item], "Id string, OrderId string, ProductId string, UnitPrice decimal(18,2)", key=("Id",), refs={"Product": Ref("Product", "ProductId", "Id"), "Order": Ref("Order", "OrderId", "Id")}, required=frozenset({"UnitPrice"})),
        ]
    )
    return lambda name: Query(catalog, name)

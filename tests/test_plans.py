"""What plans look like, and sources and sinks that the registered queries leave out."""

import json

import pytest

from quarry import engine
from quarry import errors as E
from quarry.engine import Query
from quarry.sources import Catalog, Coll, Entity, from_jdbc, from_parquet, from_rows, star_catalog
from quarry.streaming import filtered_stream

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cond(field, kind, op, *values, sort=0):
    return {"sort": sort, "field": field, "dataType": kind, "operator": op, "values": list(values)}


@pytest.fixture(scope="module")
def star(spark):
    return star_catalog(spark, SF)


def test_conditions_reach_the_scan(spark, star):
    q = Query(star, "Order")
    year = plan(q.where(cond("o_orderdate.Year", "Number", "Equal", 1997)).df)
    assert ">= 1997-01-01 00:00:00)" in year and "< 1998-01-01 00:00:00)" in year and "year(" not in year
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    pushed = plan(q.where({"conditions": [cond("o_totalprice", "Number", "GreaterThan", 5), cond("o_orderdate.Year", "Number", "Equal", 1997, sort=1)]}).df)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = pushed[pushed.index("PushedFilters"):]
    assert "GreaterThan(o_totalprice,5.0)" in pushed and "GreaterThanOrEqual(o_orderdate,1997-01-01" in pushed and "LessThan(o_orderdate,1998-01-01" in pushed
    rows = spark.createDataFrame([("a" * 8 + "-0000-0000-0000-" + "b" * 12,)], "g string")
    guid = cond("g", "Guid", "Equal", "A" * 8 + "-0000-0000-0000-" + "B" * 12)
    as_is, folded = (Query(Catalog(), Entity("T", rows, canonical_guids=frozenset(c))).where(guid).df for c in ({"g"}, ()))
    assert "lower" not in as_is._jdf.queryExecution().analyzed().toString() and "lower" in folded._jdf.queryExecution().analyzed().toString()
    assert as_is.count() == folded.count() == 1


def test_a_page_reads_its_own_children_only(star):
    request = {"selects": ["o_orderkey", "LineItems.l_quantity"], "orders": [{"field": "o_totalprice"}], "page": {"pageNumber": 1, "pageSize": 5}}
    text = Query(star, "Order").filter(request)._jdf.queryExecution().optimizedPlan().toString()
    grouped = text[text.index("Aggregate [l_orderkey"):]
    assert "Join LeftSemi" in grouped
    scan = plan(Query(star, "Order").filter(request))
    reads = [x for x in scan.splitlines() if "lineitem.parquet" in x]
    assert reads and all("ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in x for x in reads)


def test_pages_deep_and_beyond(spark, star, monkeypatch):
    q = Query(star, "Order")
    page = lambda n: {"orders": [{"field": "o_totalprice"}], "page": {"pageNumber": n, "pageSize": 7}}
    want = [r.o_orderkey for r in q.filter(page(3)).collect()]
    assert "TakeOrdered" in plan(q.filter(page(3)))
    monkeypatch.setattr(engine, "DEEP", 10)
    assert "TakeOrdered" not in plan(q.filter(page(3))) and [r.o_orderkey for r in q.filter(page(3)).collect()] == want
    assert q.filter(page(10**9)).collect() == [] and q.page({"pageNumber": (1 << 31) // 7 + 1, "pageSize": 7}).df.collect() == []
    last = q.page({"pageNumber": 2, "pageSize": (1 << 31) - 10}).df
    assert last.collect() == []


def test_streams_filter_and_project(spark, tmp_path):
    spark.range(40).selectExpr("id", "id % 4 as kind", "named_struct('x', id) as s").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, kind long, s struct<x: long>").parquet(f"{tmp_path}/in")
    kept = filtered_stream(stream, {"conditions": [cond("kind", "Number", "Equal", 1), cond("s.x", "Number", "LessThan", 20, sort=1)]}, ["id"])
    run = kept.writeStream.format("memory").queryName("kept").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination(60)
    assert sorted(r.id for r in spark.table("kept").collect()) == [1, 5, 9, 13, 17] and kept.columns == ["id"]
    with pytest.raises(ValueError):
        filtered_stream(spark.range(1), {"conditions": []})


def test_jdbc_with_json_columns(spark):
    rows = [(1, '{"city": "Ulm", "zip": [1, 2]}'), (2, '{"city": "Bonn"}'), (3, None)]
    url, driver = "jdbc:derby:memory:quarry;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.createDataFrame(rows, "ID int, PLACE string").write.jdbc(url, "PLACES", mode="overwrite", properties=driver)
    entity = from_jdbc(spark, "Place", url, "PLACES", driver, json={"PLACE": "city string, zip array<int>"}, key=("ID",))
    q = Query(Catalog([entity]), "Place")
    assert [r.ID for r in q.where(cond("Place.City", "Text", "Equal", "Bonn")).df.collect()] == [2]
    assert [r.ID for r in q.where(cond("place.zip", "Number", "IsNull")).df.orderBy("ID").collect()] == [2, 3]
    assert q.to_list({"page": {"pageNumber": 1, "pageSize": 2}}).total_count == 3


def test_json_out(spark):
    rows = [(1, None, float("nan"), [1, 2]), (2, "a\"b", 0.5, [])]
    q = Query(Catalog(), from_rows(spark, "T", rows, "Id int, Name string, X double, L array<int>", key=("Id",)))
    text = q.to_list({"orders": [{"field": "Id"}], "page": {"pageNumber": 1, "pageSize": 5}}, query_string=True).to_json()
    got = json.loads(text)
    assert (got["PageNumber"], got["PageSize"], got["PageCount"], got["TotalCount"]) == (1, 5, 1, 2) and "Sort" in got["QueryString"]
    assert got["Data"][0]["Name"] is None and got["Data"][1] == {"Id": 2, "Name": 'a"b', "X": 0.5, "L": []}


def test_parquet_source_and_collections_by_key(spark, tmp_path):
    spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string").write.parquet(f"{tmp_path}/child")
    child = from_parquet(spark, "Child", f"{tmp_path}/child")
    owner = from_rows(spark, "Owner", [(1,), (2,), (3,)], "k int", key=("k",), colls={"Children": Coll("Child", "k", "k")})
    q = Query(Catalog([owner, child]), "Owner")
    got = {r.k: [c.v for c in r.Children] for r in q.select(["k", "Children.v"]).collect()}
    assert got == {1: ["a", "b"], 2: ["c"], 3: []}, "without a key the selected values give the order"
    paged = q.filter({"selects": ["k", "Children.v"], "page": {"pageNumber": 1, "pageSize": 3}}).collect()
    assert {r.k: [c.v for c in r.Children] for r in paged} == got


def test_unknown_names_are_request_errors(star):
    for call in (lambda: star["Nobody"], lambda: Query(star, "Order").where(cond("o_orderkey", "Colour", "Equal", 1)), lambda: Query(star, "Order").where(cond("o_orderkey", 99, "Equal", 1))):
        with pytest.raises(E.LogicError):
            call()

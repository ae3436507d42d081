"""The entry module's registry."""

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_registered_for_every_engine_query():
    from quarry import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.SQL) and set(entry.oracle_sql()) <= set(entry.queries())


def test_some_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "nation", "region"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("group_deep", "nav_any_under_or", "order_coll_two_level", "having_nested", "segment_any_except", "where_text_inotin"):
        got = sorted(map(tuple, entry.queries()[name](spark, SF).collect()))
        assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall()), name

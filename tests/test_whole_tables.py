"""Queries over tables made for what the given ones do not have."""

import duckdb
import pytest

from riskspark.plans import registry


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Customers with a large order, with small ones alone (twice), with none; a name twice; an order without a customer."""
    path = str(tmp_path_factory.mktemp("shop"))
    customers = [(1, "large"), (2, "small"), (3, "none"), (4, "small"), (5, "none")]
    orders = [(10, 1, 400_000.0), (11, 2, 5.0), (12, 4, 300_000.0), (13, 4, 7.0), (14, 9, 500_000.0), (15, None, 1.0)]
    spark.createDataFrame(customers, "c_custkey long, c_name string").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    return path


def same_as_sql(spark, path, name):
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, path)
    want = con.sql(registry.ORACLES[name])
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall())
    return rows


def test_every_order_sets_the_flag(spark, shop):
    assert same_as_sql(spark, shop, "f4_exists_flag") == [(1, True), (2, True), (3, False), (4, True), (5, False)]


def test_every_order_makes_a_member(spark, shop):
    assert same_as_sql(spark, shop, "j2_members") == [(1, "large"), (2, "small"), (4, "small")]


def test_every_order_is_held_by_the_filter(spark, shop):
    assert same_as_sql(spark, shop, "b9_bloom_members") == [("large", True), ("small", True), ("small", True)]


def test_every_posting_counts_in_a_grown_index(spark, tmp_path):
    """A document with both words, in more than a hundred shorter ones that have either."""
    path, n = str(tmp_path), 120
    docs = [(k, "north", "en") for k in range(n)] + [(n + k, "south", "de") for k in range(n)] + [(900, "south of north", "en"), (901, "other", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "north south"), (2, "none"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    rows = sorted(map(tuple, registry.QUERIES["st10_segmented_search"](spark, path).collect()))
    assert rows == sorted(con.sql(registry.ORACLES["st10_segmented_search"]).fetchall())
    assert [r[1] for r in rows if r[0] == 1 and r[3] == 1] == [900]

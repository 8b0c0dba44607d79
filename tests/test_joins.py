"""Joins of the library on rows that the tables don't have: nulls, clashing names, wide ranges, ties."""

from datetime import datetime

from quillon.operators import joins
from quillon.plans import catalog


def test_as_of_with_nulls_and_spans(spark):
    at = lambda m, d: datetime(2024, m, d)
    left = spark.createDataFrame([(1, 1, at(1, 5)), (2, 1, at(3, 1)), (3, None, at(3, 1)), (4, 2, at(3, 1)), (5, 1, None), (6, 1, at(1, 1))], "id long, k long, t timestamp")
    right = spark.createDataFrame([(1, at(1, 2), 10), (1, at(1, 5), 11), (1, at(1, 5), 12), (None, at(1, 1), 13), (2, at(4, 1), 14), (1, None, 15)], "k long, t timestamp, v long")
    got = {r.id: r.out for r in joins.as_of(left.withColumnRenamed("id", "id"), right, "k", "t", "v", "out").collect()}
    assert got == {1: 12, 2: 12, 3: None, 4: None, 5: None, 6: None}


def test_as_of_lets_columns_have_any_name(spark):
    left = spark.createDataFrame([(1, 5, 7, 8)], "k long, t long, __side long, __cell long").selectExpr("k", "timestamp_seconds(t) AS t", "__side", "__cell")
    right = spark.createDataFrame([(1, 5, 3)], "k long, t long, v long").selectExpr("k", "timestamp_seconds(t) AS t", "v")
    assert [tuple(r)[2:] for r in joins.as_of(left, right, "k", "t", "v", "out").collect()] == [(7, 8, 3)]


def test_range_join_with_wide_ranges(spark):
    points = [(i, i * 3.5 - 40) for i in range(200)] + [(900, None)]
    ranges = [(0, -50.0, 1e9), (1, 0.0, 0.5), (2, 10.0, 10.0), (3, 100.0, 350.0), (4, None, 5.0), (5, -1e12, -20.0), (6, 7.0, 8.0)]
    got = joins.range_join(spark.createDataFrame(points, "i long, x double"), spark.createDataFrame(ranges, "r long, low double, high double"), "x", "low", "high", 1.0)
    want = {(i, r) for i, x in points for r, a, b in ranges if None not in (x, a, b) and a <= x < b}
    assert sorted((r.i, r.r) for r in got.collect()) == sorted(want)
    assert got.columns == ["i", "x", "r", "low", "high"]
    none = spark.createDataFrame([], "r long, low double, high double")
    assert joins.range_join(spark.createDataFrame(points, "i long, x double"), none, "x", "low", "high", 1.0).count() == 0


def test_salted_join_lets_columns_have_any_name(spark):
    large = spark.createDataFrame([(1, i, i) for i in range(50)], "k long, v long, __salt long")
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k long, w string")
    assert sorted(tuple(r) for r in joins.salted_join(large, small, "k").collect()) == [(1, i, i, "a") for i in range(50)]


def test_broadcast_behind_a_size_joins_all_orders(spark):
    """The rows are those of the same join by another hint, whether orders are broadcast or not."""
    sf = "/root/testdata/sf0.01"
    want = sorted(map(tuple, catalog.queries()["join_hint_merge"](spark, sf).collect()))
    assert sorted(map(tuple, catalog.queries()["join_hint_broadcast"](spark, sf).collect())) == want
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    hinted = lambda most: "ResolvedHint" in joins.small(orders, most)._jdf.queryExecution().analyzed().toString()
    assert hinted(15_000) and not hinted(14_999)

"""Tables in sorted buckets of a key: joined, and aggregated, on that key without moving a row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import Registry
from quillon.session import table

registry = Registry()


def bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None) -> str:
    """Write df to the warehouse as a table of so many buckets of key, one sorted file each, and return its name.

    Tables that are joined must have equal numbers of buckets: choose one for a bucket of the largest to fit a task. The
    rows are dealt by key first, so that a bucket is one file and stays sorted when it is read. A hot key is one bucket:
    such keys are for a salted join instead.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    return name


def joined(spark: SparkSession, left: str, right: str, key: str, how: str = "inner") -> DataFrame:
    """Two tables of equal buckets, merged bucket by bucket."""
    return spark.table(left).hint("merge").join(spark.table(right), key, how)


def _tables(spark: SparkSession, sf_dir: str, buckets: int) -> tuple[str, str]:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_custkey")
    return bucketed(lines, "orderkey", buckets), bucketed(orders, "orderkey", buckets)


@registry.query("SELECT o_orderkey AS orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _tables(spark, sf_dir, 12)
    return joined(spark, lines, orders, "orderkey").select("orderkey", "l_linenumber", "l_partkey", "o_custkey")


@registry.query("SELECT l_orderkey AS orderkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def aggregate_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join and an aggregate on the buckets' key, in one stage."""
    lines, orders = _tables(spark, sf_dir, 12)
    both = joined(spark, lines, orders, "orderkey")
    return both.groupBy("orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("quantity"))

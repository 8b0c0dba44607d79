"""Window functions, per-group top-k, batch event-time windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import Registry
from quillon.session import table

registry = Registry()

registry.spark_sql(
    "window_ranks", "orders",
    """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER p AS BIGINT) AS rk, CAST(dense_rank() OVER p AS BIGINT) AS dr,
              round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS nt
       FROM {orders} WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
)
registry.spark_sql(
    "window_offsets", "orders",
    """SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after,
              first_value(o_orderkey) OVER f AS first_key, last_value(o_orderkey) OVER f AS last_key, nth_value(o_orderkey, 2) OVER f AS second_key
       FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
       f AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
registry.spark_sql(
    "window_rows_frame", "orders",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM {orders}",
)
registry.spark_sql(
    "window_range_frame", "events",
    "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW), 4) AS s FROM {events}",
)
registry.spark_sql(
    "top_k_per_group", "orders",
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) x WHERE rn <= 3",
)
registry.spark_sql(
    "qualify_rewrite", "orders",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}) x WHERE n > 20",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 20",
)


registry.spark_sql(
    "window_groups_frame", "orders",
    # a frame of groups of equal dates is a range over their ranks
    """SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s
       FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS g FROM {orders}) x""",
    "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders",
)
registry.spark_sql(
    "window_exclude_current", "orders",
    # EXCLUDE CURRENT ROW: the two frames beside the row
    """SELECT o_orderkey, count(*) OVER before + count(*) OVER after AS n,
              greatest(max(o_totalprice) OVER before, max(o_totalprice) OVER after) AS high FROM {orders}
       WINDOW before AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
              after AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
    """SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS high FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)""",
)


@registry.query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("window.start").alias("start"), "event_type", "n")


@registry.query(
    """SELECT start, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start
       FROM events) GROUP BY start"""
)
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("window.start").alias("start"), "n")


@registry.query(
    """SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s
       FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return d.select("user_id", F.col("session_window.start").alias("start"), "n")

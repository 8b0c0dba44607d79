"""Aggregation: hash, distinct, grouping sets, statistics, ordered and approximate ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import Registry
from quillon.session import table

registry = Registry()

registry.spark_sql(
    "pricing_summary", "lineitem",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_qty,
              CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS sum_disc,
              round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n
       FROM {lineitem} WHERE l_shipdate <= TIMESTAMP_NTZ '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_qty,
              CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS sum_disc,
              round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
registry.spark_sql("agg_basic", "orders", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, max(o_orderpriority) AS last_priority FROM {orders} GROUP BY o_orderstatus")
registry.spark_sql("agg_count_distinct", "lineitem", "SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM {lineitem} GROUP BY l_returnflag")
registry.spark_sql(
    "agg_filter_having", "lineitem",
    "SELECT l_suppkey, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS big, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 500",
)
for kind, clause in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")):
    registry.spark_sql(
        f"agg_{kind}", "lineitem",
        f"""SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS BIGINT) AS g, CAST(count(*) AS BIGINT) AS n,
                   CAST(sum(l_linenumber) AS BIGINT) AS lines FROM {{lineitem}} GROUP BY {clause}""",
    )
registry.spark_sql(
    "agg_statistics", "orders",
    """SELECT o_orderpriority, round(stddev_samp(o_totalprice), 4) AS sd, round(var_pop(o_totalprice) / 1e6, 4) AS vp,
              round(corr(o_totalprice, o_custkey), 6) AS r, round(skewness(o_totalprice), 4) AS skew,
              round(covar_samp(o_totalprice, o_custkey) / 1e6, 4) AS cov, round(regr_slope(o_totalprice, o_custkey), 6) AS slope FROM {orders} GROUP BY o_orderpriority""",
    """SELECT o_orderpriority, round(stddev_samp(o_totalprice), 4) AS sd, round(var_pop(o_totalprice) / 1e6, 4) AS vp,
              round(corr(o_totalprice, o_custkey), 6) AS r,
              round((avg(o_totalprice ** 3) - 3 * avg(o_totalprice) * avg(o_totalprice ** 2) + 2 * avg(o_totalprice) ** 3) / var_pop(o_totalprice) ** 1.5, 4) AS skew,
              round(covar_samp(o_totalprice, o_custkey) / 1e6, 4) AS cov, round(regr_slope(o_totalprice, o_custkey), 6) AS slope FROM orders GROUP BY o_orderpriority""",
)
registry.spark_sql(
    "agg_kurtosis", "orders", "SELECT o_orderstatus, round(kurtosis(o_totalprice), 3) AS k FROM {orders} GROUP BY o_orderstatus",
    "SELECT o_orderstatus, round(kurtosis_pop(o_totalprice), 3) AS k FROM orders GROUP BY o_orderstatus",
)
registry.spark_sql(
    "agg_percentiles", "orders",
    """SELECT o_orderstatus, median(o_totalprice) AS med, percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS q1,
              percentile_disc(0.75) WITHIN GROUP (ORDER BY o_totalprice) AS q3 FROM {orders} GROUP BY o_orderstatus""",
)
registry.spark_sql(
    "agg_max_by", "orders", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS best, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS worst FROM {orders} GROUP BY o_custkey",
    "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst FROM orders GROUP BY o_custkey",
)
registry.spark_sql("agg_bool_bit", "lineitem", "SELECT l_linestatus, bool_and(l_quantity > 0) AS all_pos, bool_or(l_quantity > 49) AS any_big, bit_xor(l_orderkey) AS bx FROM {lineitem} GROUP BY l_linestatus")
registry.spark_sql(
    "agg_collect_sorted", "nation", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
registry.spark_sql("agg_mode", "lineitem", "SELECT l_returnflag, mode(l_linestatus) AS m FROM {lineitem} GROUP BY l_returnflag")


@registry.query()
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches have no exact oracle: rows only."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_suppkey")).alias("suppliers"),
        F.percentile_approx("l_quantity", 0.5).alias("median"),
    )


registry.spark_sql(
    "agg_sketches_checked", "lineitem",
    # each sketch against the exact value: whether the error lies within the sketch's bound
    """SELECT l_returnflag, abs(approx_count_distinct(l_partkey, 0.02) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS hyperloglog,
              abs(hll_sketch_estimate(hll_sketch_agg(l_suppkey)) - count(DISTINCT l_suppkey)) <= 0.1 * count(DISTINCT l_suppkey) + 1 AS hll,
              abs(theta_sketch_estimate(theta_sketch_agg(l_partkey)) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) + 1 AS theta,
              abs(percentile_approx(l_quantity, 0.5) - percentile(l_quantity, 0.5)) <= 1 AS quantile,
              abs(kll_sketch_get_quantile_bigint(kll_sketch_agg_bigint(CAST(l_quantity AS BIGINT)), 0.5) - percentile(l_quantity, 0.5)) <= 3 AS kll,
              transform(approx_top_k(l_linenumber, 3), x -> x.count) = slice(sort_array(array(count_if(l_linenumber = 1), count_if(l_linenumber = 2), count_if(l_linenumber = 3),
                count_if(l_linenumber = 4), count_if(l_linenumber = 5), count_if(l_linenumber = 6), count_if(l_linenumber = 7)), false), 1, 3) AS top_k,
              aggregate(histogram_numeric(l_quantity, 5), 0D, (a, b) -> a + b.y) = count(*) AND
                abs(aggregate(histogram_numeric(l_quantity, 5), 0D, (a, b) -> a + b.x * b.y) / count(*) - avg(l_quantity)) < 1e-6 AS histogram FROM {lineitem} GROUP BY l_returnflag""",
    """SELECT l_returnflag, true AS hyperloglog, true AS hll, true AS theta, true AS quantile, true AS kll, true AS top_k, true AS histogram
       FROM lineitem GROUP BY l_returnflag""",
)


registry.spark_sql(
    "agg_regression", "lineitem",
    """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
              round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, round(covar_pop(l_extendedprice, l_quantity), 2) AS cov, round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx,
              round(regr_avgy(l_extendedprice, l_quantity), 4) AS mean, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM {lineitem} GROUP BY l_returnflag""",
)


@registry.query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def agg_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps for hot keys when what is aggregated cannot be combined early: by key and salt, then by key."""
    salt = F.pmod(F.xxhash64("event_id"), F.lit(16)).alias("salt")
    parts = table(spark, sf_dir, "events").groupBy("event_type", salt).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))

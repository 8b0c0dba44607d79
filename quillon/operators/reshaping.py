"""Projection, filters, pivots, explosion, sets, sorting and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import Registry
from quillon.session import table

registry = Registry()

registry.spark_sql("project_derived", "lineitem", "SELECT l_orderkey AS order_id, l_linenumber AS line, round(l_extendedprice * (1 - l_discount), 4) AS net FROM {lineitem} WHERE l_tax > 0.03")
registry.spark_sql("filter_like", "part", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%ing%' AND p_brand ILIKE '%B%' AND p_size BETWEEN 5 AND 20")
registry.spark_sql("case_coalesce_nullif", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'P'), '?') AS st FROM {orders}")
registry.spark_sql("try_cast_in", "part", "SELECT p_partkey, try_cast(p_brand AS INT) AS b, p_size IN (1, 2, NULL) AS hit FROM {part}")
registry.spark_sql(
    "pivot", "lineitem", "SELECT * FROM (SELECT l_returnflag, l_linestatus FROM {lineitem}) PIVOT (count(*) FOR l_linestatus IN ('F' AS f, 'O' AS o))",
    "SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS o FROM lineitem GROUP BY l_returnflag",
)
registry.spark_sql(
    "unpivot", "lineitem", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM {lineitem}) UNPIVOT (v FOR k IN (l_discount, l_tax))",
    "SELECT l_orderkey, l_linenumber, k, v FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR k IN (l_discount, l_tax))",
)
registry.spark_sql(
    "explode_positions", "embeddings", "SELECT vec_id, CAST(pos AS BIGINT) AS pos, x FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, x",
    "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos, unnest(embedding) AS x FROM embeddings",
)
registry.spark_sql("stack_rows", "region", "SELECT r_regionkey, stack(2, 'key', CAST(r_regionkey AS STRING), 'name', r_name) AS (k, v) FROM {region}", "SELECT r_regionkey, 'key' AS k, CAST(r_regionkey AS VARCHAR) AS v FROM region UNION ALL SELECT r_regionkey, 'name', r_name FROM region")
registry.spark_sql(
    "recursive_cte", "region", "WITH RECURSIVE t(n, s) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 20) SELECT t.n, t.s FROM t WHERE n <= (SELECT 4 * count(*) FROM {region})",
)
registry.spark_sql(
    "pipe_syntax", "orders", "FROM {orders} |> WHERE o_totalprice > 100000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus",
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus",
)
registry.spark_sql(
    "explode_outer_rows", "nation", "SELECT n_nationkey, explode_outer(CASE WHEN n_regionkey > 1 THEN array(n_regionkey, n_regionkey * 10) END) AS x FROM {nation}",
    "SELECT n_nationkey, unnest(CASE WHEN n_regionkey > 1 THEN [n_regionkey, n_regionkey * 10] ELSE [NULL] END) AS x FROM nation",
)
registry.spark_sql(
    "inline_rows", "nation", "SELECT n_nationkey, inline(array(struct(n_name AS v, 1 AS i), struct(upper(n_name) AS v, 2 AS i))) FROM {nation}",
    "SELECT n_nationkey, n_name AS v, 1 AS i FROM nation UNION ALL SELECT n_nationkey, upper(n_name), 2 FROM nation",
)
registry.spark_sql("sort_global", "orders", "SELECT o_orderkey, o_orderdate, o_totalprice FROM {orders} ORDER BY o_orderdate, o_totalprice DESC, o_orderkey")
registry.spark_sql("top_k", "orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
registry.spark_sql("limit_offset", "orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
for name, op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    registry.spark_sql(f"set_{name}", "customer supplier", f"SELECT c_nationkey AS k FROM {{customer}} {op} SELECT s_nationkey FROM {{supplier}} WHERE s_acctbal > 5000")
registry.spark_sql("distinct_rows", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}")


@registry.query("SELECT n_nationkey AS k, n_name AS name, NULL AS balance FROM nation UNION ALL SELECT s_nationkey, s_name, s_acctbal FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "n_name AS name")
    return a.unionByName(table(spark, sf_dir, "supplier").selectExpr("s_acctbal AS balance", "s_name AS name", "s_nationkey AS k"), allowMissingColumns=True)


@registry.query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def dedupe_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key: an aggregate, so the kept row does not depend on the order of arrival."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@registry.query()
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows, the same ones again for the same files."""
    return table(spark, sf_dir, "orders").sample(fraction=0.1, seed=7)


@registry.query("SELECT true AS within, true AS no_repeats, true AS share_close")
def sample_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any sample of a tenth: its rows are the table's, none comes twice, and the share lies within six deviations."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    drawn = sample_rows(spark, sf_dir).select("o_orderkey", F.lit(1).alias("hit"))
    both = orders.withColumn("row", F.lit(1)).join(drawn, "o_orderkey", "full").groupBy("o_orderkey").agg(F.sum("row").alias("rows"), F.sum("hit").alias("hits"))
    n, k = F.sum(F.coalesce("rows", F.lit(0))), F.sum(F.coalesce("hits", F.lit(0)))
    share = F.abs(k - 0.1 * n) <= 6 * F.sqrt(0.09 * n) + 1
    return both.agg(F.bool_and(F.col("rows").isNotNull()).alias("within"), F.bool_and(F.coalesce("hits", F.lit(0)) <= F.col("rows")).alias("no_repeats"), share.alias("share_close"))


@registry.query("SELECT s_suppkey AS supplier, s_name AS s_title, s_nationkey FROM supplier")
def rename_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "supplier", "s_name": "s_title"}).drop("s_acctbal")


@registry.query("SELECT CAST(i AS BIGINT) AS k, CAST(i * i AS BIGINT) AS square, count(o_orderkey) AS orders FROM (SELECT unnest(range(0, (SELECT max(o_custkey) + 1 FROM orders), 7)) AS i) LEFT JOIN orders ON o_custkey = i GROUP BY i")
def range_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh number up to the largest customer, with or without orders."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_custkey")).first()[0]
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    numbers = spark.range(0, (-1 if last is None else last) + 1, 7).selectExpr("id AS k", "id * id AS square")
    return numbers.join(counts, F.col("k") == F.col("o_custkey"), "left").select("k", "square", F.coalesce("orders", F.lit(0)).alias("orders"))


@registry.query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def sort_within_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey").repartition("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")

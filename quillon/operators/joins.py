"""Joins: equi, outer, semi, anti, theta, interval, as-of, range, lateral and correlated."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillon.operators.columns import temporary
from quillon.plans.registry import Registry
from quillon.session import table

registry = Registry()

registry.spark_sql(
    "revenue_by_priority", "lineitem orders customer nation region",
    """SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n_lines,
              CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS revenue
       FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
            JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
       WHERE r_name = 'ASIA' AND year(o_orderdate) = 1996 GROUP BY o_orderpriority""",
)
registry.spark_sql("join_inner", "lineitem orders", "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey")
for kind in ("left", "right", "full"):
    registry.spark_sql(
        f"join_{kind}_outer", "orders lineitem",
        f"""SELECT o.o_orderkey, o.o_custkey, l.l_orderkey, l.l_partkey FROM {{orders}} o {kind} JOIN
            (SELECT * FROM {{lineitem}} WHERE l_quantity > 45) l ON o.o_orderkey = l.l_orderkey""",
    )
registry.spark_sql(
    "join_left_semi", "orders lineitem", "SELECT o_orderkey FROM {orders} LEFT SEMI JOIN {lineitem} ON o_orderkey = l_orderkey AND l_quantity > 45",
    "SELECT o_orderkey FROM orders SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) l ON o_orderkey = l_orderkey",
)
registry.spark_sql(
    "join_left_anti", "orders lineitem", "SELECT o_orderkey FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey",
    "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey",
)
registry.spark_sql("exists_subquery", "customer orders", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
registry.spark_sql("not_exists_subquery", "customer orders", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
registry.spark_sql("not_in_null_aware", "nation supplier", "SELECT n_nationkey, n_name FROM {nation} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal < 0)")
registry.spark_sql("join_theta", "nation region", "SELECT n_nationkey, r_regionkey FROM {nation} JOIN {region} ON n_regionkey < r_regionkey")
registry.spark_sql("join_cross", "nation region", "SELECT n_name, r_name FROM {nation} CROSS JOIN {region}")
registry.spark_sql("not_in_with_null", "nation supplier", "SELECT count(*) AS n FROM {nation} WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM {supplier} WHERE s_acctbal < 9000)")
# the strategy is named by a hint; the results are those of the plain join
for hint, condition in (("merge", "l_orderkey = o_orderkey"), ("shuffle_hash", "l_orderkey = o_orderkey")):
    registry.spark_sql(
        f"join_hint_{hint}", "lineitem orders",
        f"SELECT /*+ {hint}(o) */ l.l_orderkey, l.l_linenumber, o.o_custkey FROM {{lineitem}} l JOIN {{orders}} o ON {condition} WHERE l_quantity > 40",
        f"SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l JOIN orders o ON {condition} WHERE l_quantity > 40",
    )
registry.spark_sql(
    "join_hint_nested_loop", "nation region", "SELECT /*+ shuffle_replicate_nl(r) */ n.n_nationkey, r.r_regionkey FROM {nation} n JOIN {region} r ON n.n_regionkey > r.r_regionkey",
    "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey > r.r_regionkey",
)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has `most` rows or fewer, which is looked up first; otherwise Spark chooses."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@registry.query("SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey WHERE l_quantity > 40")
def join_hint_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broadcast behind a check of its size: more orders than that are joined as Spark chooses."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_linenumber")
    return lines.join(small(orders), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


# a click is dealt to its two-hour cell and the next, so a user's events meet by cell and not all with all
_CELL = "timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) DIV 2"
registry.spark_sql(
    "join_interval", "events",
    f"""SELECT a.event_id AS click_id, b.event_id AS purchase_id
        FROM (SELECT event_id, user_id, ts, explode(array({_CELL}, {_CELL} + 1)) AS cell FROM {{events}} WHERE event_type = 'click') a
        JOIN (SELECT event_id, user_id, ts, {_CELL} AS cell FROM {{events}} WHERE event_type = 'purchase') b
        ON a.user_id = b.user_id AND a.cell = b.cell AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '2' HOUR""",
    """SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b
       ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '2' HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'""",
)
registry.spark_sql(
    "correlated_scalar", "lineitem",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} a
       WHERE l_quantity > (SELECT avg(l_quantity) FROM {lineitem} b WHERE b.l_partkey = a.l_partkey)""",
)
registry.spark_sql(
    "lateral_top", "customer orders",
    """SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM {customer} c, LATERAL
       (SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t""",
)


def as_of(left: DataFrame, right: DataFrame, by: str, on: str, value: str, out: str, span: str = "month") -> DataFrame:
    """left with the last value of right at or before each row's time, by key: no pairs are made.

    Both sides are stacked and a running last value is carried forward within a key's span of time, and
    from span to span by a second, short window; so a hot key is as many tasks as it has spans. Null keys
    and times match nothing: such rows of left keep a null. A right row of a null value is a match as any other and
    gives null. Of right rows of one time the largest value counts, null being the smallest.
    """
    side, cell, own, carried = (temporary(x, left, right) for x in ("side", "cell", "own", "carried"))
    columns = [F.col(c) for c in left.columns]
    clear = F.col(by).isNotNull() & F.col(on).isNotNull()
    kind = right.schema[value].dataType
    none = F.lit(None).cast(StructType([StructField("v", kind)]))  # a struct tells a null value from no match
    known = right.where(clear).select(by, on, F.struct(F.col(value).alias("v")).alias(own), F.lit(0).alias(side))
    stacked = left.where(clear).withColumn(own, none).withColumn(side, F.lit(1)).unionByName(known, allowMissingColumns=True)
    stacked = stacked.withColumn(cell, F.date_trunc(span, on))
    last = stacked.groupBy(by, cell).agg(F.max_by(own, F.when(F.col(own).isNotNull(), F.struct(on, own))).alias(carried))
    earlier = Window.partitionBy(by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn(carried, F.last(carried, ignorenulls=True).over(earlier))
    before = Window.partitionBy(by, cell).orderBy(on, side, own).rowsBetween(Window.unboundedPreceding, 0)
    found = stacked.withColumn(own, F.last(own, ignorenulls=True).over(before)).where(F.col(side) == 1).join(last, [by, cell])
    matched = found.select(*columns, F.coalesce(own, carried)["v"].alias(out))
    return matched.unionAll(left.where(~clear).select(*columns, F.lit(None).cast(kind).alias(out)))


@registry.query(
    """SELECT p.event_id, p.user_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"""
)
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return as_of(purchases, clicks, "user_id", "ts", "event_id", "click_id").drop("ts")


@registry.query(
    """SELECT p.event_id, p.user_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"""
)
def join_as_of_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by cogrouped pandas: a key's rows meet in one task, so for keys of a bounded size only."""

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = pd.merge_asof(left.sort_values("ts"), right.sort_values("click_ts"), left_on="ts", right_on="click_ts")
        return pd.DataFrame({"event_id": found.event_id, "user_id": found.user_id, "click_id": found.click_id.astype("Int64")})

    events = table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").selectExpr("user_id AS click_user", "ts AS click_ts", "event_id AS click_id")
    both = purchases.groupBy("user_id").cogroup(clicks.groupBy("click_user"))
    return both.applyInPandas(match, "event_id long, user_id long, click_id long")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """points with each range [low, high) that holds them: ranges are dealt to cells, then equi-joined.

    A range wider than `width` goes to a grid of twice, four times, ... that width, so that it lies in two
    cells at most; a point is looked up once in each grid that is used, of which there are 64 at most.
    """
    cell, grid = (temporary(x, points, ranges) for x in ("cell", "grid"))
    size = lambda g: F.lit(float(width)) * F.pow(F.lit(2.0), g)
    place = lambda c: F.floor(F.col(c) / size(F.col(grid)))
    dealt = ranges.where(F.col(low) < F.col(high)).withColumn(grid, F.greatest(F.ceil(F.log2((F.col(high) - F.col(low)) / width)), F.lit(0)).cast("int"))
    grids = sorted(r[0] for r in dealt.select(grid).distinct().collect())
    cells = dealt.withColumn(cell, F.explode(F.sequence(place(low), place(high))))
    keyed = points.withColumn(grid, F.explode(F.array(*[F.lit(g) for g in grids]).cast("array<int>"))).withColumn(cell, place(point))
    return keyed.join(cells, [grid, cell]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(grid, cell)


@registry.query(
    """SELECT o_orderkey, p_partkey FROM orders JOIN (SELECT p_partkey, p_retailprice * 100 AS low, p_retailprice * 100 + 40 AS high FROM part WHERE p_size < 10) p
       ON o_totalprice >= low AND o_totalprice < high"""
)
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "part").where("p_size < 10").selectExpr("p_partkey", "p_retailprice * 100 AS low", "p_retailprice * 100 + 40 AS high")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return range_join(orders, ranges, "o_totalprice", "low", "high", 1000.0).select("o_orderkey", "p_partkey")


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int = 8, spread: Column | None = None) -> DataFrame:
    """Inner join whose large side's hot keys are dealt to `salts` tasks; the small side is repeated so often."""
    salt = temporary("salt", large, small)
    dealt = large.withColumn(salt, F.pmod(F.xxhash64(*(large.columns if spread is None else [spread])), F.lit(salts)))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [key, salt]).drop(salt)


@registry.query("SELECT e.event_id, e.event_type, t.weight FROM events e JOIN (SELECT event_type, CAST(length(event_type) AS BIGINT) AS weight FROM events GROUP BY event_type) t ON e.event_type = t.event_type")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    types = events.groupBy("event_type").agg(F.first(F.length("event_type").cast("long")).alias("weight"))
    return salted_join(events, types, "event_type").select("event_id", "event_type", "weight")

"""User-defined functions: scalar, vectorised, aggregate, table, grouped, cogrouped, SQL."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf, udf, udtf
from pyspark.sql.types import IntegralType, LongType, StructField, StructType, TimestampNTZType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillon.plans.registry import Registry
from quillon.session import table

registry = Registry()


@registry.query("SELECT p_partkey, p_size * 2 + 1 AS y FROM part")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row-at-a-time form, here for its surface alone: `udf_pandas` and `udf_arrow` take whole batches."""
    return table(spark, sf_dir, "part").select("p_partkey", udf(lambda x: x * 2 + 1, "int")("p_size").alias("y"))


@registry.query("SELECT p_partkey, p_retailprice * 2 AS y FROM part")
def udf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    @pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    return table(spark, sf_dir, "part").select("p_partkey", twice("p_retailprice").alias("y"))


@registry.query("SELECT p_partkey, p_size * 3 AS y FROM part")
def udf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    @arrow_udf("int")
    def triple(x: pa.Array) -> pa.Array:
        return pc.multiply(x, pa.scalar(3, x.type))

    return table(spark, sf_dir, "part").select("p_partkey", triple("p_size").alias("y"))


@registry.query("SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE o_totalprice <= 100000")
def map_arrow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def cheap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            x = x.filter(pc.less_equal(x.column("o_totalprice"), 100000.0))
            yield pa.RecordBatch.from_arrays([x.column("o_orderkey"), pc.divide(x.column("o_totalprice"), 2.0)], names=["o_orderkey", "half"])

    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInArrow(cheap, "o_orderkey long, half double")


@registry.query("SELECT p_type, round(avg(p_retailprice), 6) AS m FROM part GROUP BY p_type")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two steps, as a worker holds all rows that it aggregates: over dealt parts of a group, then over the parts' results."""

    @pandas_udf("double")
    def total(x: pd.Series) -> float:
        return float(x.sum())

    part = F.pmod(F.xxhash64("p_partkey"), F.lit(64)).alias("part")
    parts = table(spark, sf_dir, "part").groupBy("p_type", part).agg(total("p_retailprice").alias("s"))
    sizes = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("p_retailprice").alias("n"))
    return parts.groupBy("p_type").agg(F.sum("s").alias("s")).join(sizes, "p_type").select("p_type", F.round(F.col("s") / F.col("n"), 6).alias("m"))


@registry.query("SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_type), 6) AS m FROM part")
def udf_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker holds a partition of the window, so for partitions of a bounded size only; others take the built-in mean."""

    @pandas_udf("double")
    def mean(x: pd.Series) -> float:
        return float(x.mean())

    return table(spark, sf_dir, "part").select("p_partkey", F.round(mean("p_retailprice").over(Window.partitionBy("p_type")), 6).alias("m"))


@registry.query("SELECT r_regionkey, r_regionkey * i AS y FROM region, (SELECT unnest([1, 2]) AS i)")
def udtf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    @udtf(returnType="y int")
    class Multiples:
        def eval(self, x: int):
            yield (x,)
            yield (2 * x,)

    spark.udtf.register("multiples", Multiples)
    return spark.sql("SELECT r_regionkey, t.y FROM {region}, LATERAL multiples(r_regionkey) t", region=table(spark, sf_dir, "region"))


@udtf
class Sessionize:
    """Sessions of the rows of a table, by time: TABLE(events) PARTITION BY user_id ORDER BY ts, gap in minutes.

    An event up to a gap after the last one belongs to its session. A partition's rows come one by one and only the open session is held, so a partition may be of any size.
    """

    @staticmethod
    def analyze(row: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not row.isTable or not isinstance(gap.dataType, IntegralType):
            raise ValueError("a table and a whole number of minutes are needed")
        if missing := {"user_id", "ts"} - set(row.dataType.names):
            raise ValueError(f"the table lacks {sorted(missing)}")
        return AnalyzeResult(StructType([StructField("user_id", LongType()), StructField("start", TimestampNTZType()), StructField("n", LongType())]))

    def __init__(self) -> None:
        self.user = self.start = self.last = None
        self.n = 0

    def eval(self, row: Row, gap: int) -> Iterator[tuple]:
        if self.n and row["ts"] > self.last + timedelta(minutes=gap):
            yield self.user, self.start, self.n
            self.n = 0
        if not self.n:
            self.user, self.start = row["user_id"], row["ts"]
        self.last, self.n = row["ts"], self.n + 1

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.user, self.start, self.n


@registry.query(
    """SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s
       FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def udtf_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("sessionize", Sessionize)
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    return spark.sql("SELECT * FROM sessionize(row => TABLE({events}) PARTITION BY user_id ORDER BY ts, gap => 30)", events=events)


@registry.query("SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_type), 4) AS d FROM part")
def udf_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker holds a group, so for groups of a bounded size only; for others, join the groups' means."""

    def centre(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p_partkey": x.p_partkey, "d": (x.p_retailprice - x.p_retailprice.mean()).round(4)})

    return table(spark, sf_dir, "part").groupBy("p_type").applyInPandas(centre, "p_partkey long, d double")


@registry.query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def dear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.loc[x.o_totalprice > 200000, ["o_orderkey"]]

    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInPandas(dear, "o_orderkey long")


@registry.query("SELECT n_regionkey, CAST(count(*) AS BIGINT) AS nations, CAST(any_value(r_name) AS VARCHAR) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
def udf_cogrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_regionkey": b.r_regionkey, "nations": len(a), "r_name": b.r_name})

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.groupBy("n_regionkey").cogroup(region.groupBy("r_regionkey")).applyInPandas(both, "n_regionkey int, nations long, r_name string")


@registry.query("SELECT s_suppkey, round(s_acctbal * 1.1, 2) AS y FROM supplier")
def udf_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION with_interest(x DOUBLE) RETURNS DOUBLE RETURN round(x * 1.1D, 2)")
    return spark.sql("SELECT s_suppkey, with_interest(s_acctbal) AS y FROM {supplier}", supplier=table(spark, sf_dir, "supplier"))

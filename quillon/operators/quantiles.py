"""Exact quantiles of groups of any size, by counts of ever finer bins instead of a group's values in one buffer.

The first pass counts, for each group, values by sign, power of two and sixteenth of it. Running sums of the counts tell
in which bin each wanted rank lies; only rows of those bins go on, to be counted in 65,536 equal bins between the bin's
least and largest value, and so on until such a bin holds one value. Bins only need to keep the order of values, which
floating-point arithmetic does, so the result is one of the values or lies between two of them, as it should.
A pass combines counts before it shuffles them; no task holds a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.registry import Registry
from quillon.session import table
from quillon.sources.shared import staged

registry = Registry()

#: Equal bins of each pass after the first.
BINS = 65_536


def _first_bin(x: Column) -> Column:
    """A number that never falls as x grows: infinities and NaN, the greatest value, at the ends; small numbers near 0."""
    size = F.floor(F.log2(F.abs(x)) * 16) + 20_000
    signed = F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)
    return F.when(F.isnan(x), 99_999).when(x == float("inf"), 99_998).when(x == float("-inf"), -99_998).otherwise(signed).cast("int")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """by and a column for each of wanted: name -> ("cont" or "disc", share), as percentile_cont and percentile_disc define them.

    The value is taken as a double (integers are exact up to 2^53). Nulls are left out, NaN counts as the greatest value,
    a group without values gives no row (without `by`: one of nulls), a null key is a group of its own.
    """
    for kind, share in wanted.values():
        if kind not in ("cont", "disc") or not 0 <= share <= 1:
            raise ValueError(f"no quantile: {kind} {share}")
    keys = [f"g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    n = F.col("n")
    place = {name: share * (n - 1) if kind == "cont" else F.greatest(F.ceil(share * n) - 1, F.lit(0)) for name, (kind, share) in wanted.items()}
    low, high = {k: F.floor(p).cast("long") for k, p in place.items()}, {k: F.ceil(p).cast("long") for k, p in place.items()}
    ranks = F.array_distinct(F.array(*low.values(), *high.values()))

    counts = [F.count(F.lit(1)).alias("rows"), F.min("x").alias("low"), F.max("x").alias("high")]
    bins = rows.groupBy(*keys, _first_bin(F.col("x")).alias("bin")).agg(*counts)
    group = Window.partitionBy(*keys)
    ahead = lambda w: F.coalesce(F.sum("rows").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("n", F.sum("rows").over(group)).withColumn("ahead", ahead(group)).withColumn("ranks", ranks)
    found = None
    while True:
        inside = F.filter("ranks", lambda r: (r >= F.col("ahead")) & (r < F.col("ahead") + F.col("rows")))
        bins = staged(bins.withColumn("ranks", inside).where(F.size("ranks") > 0), "bins")
        done = bins.where("low = high").select(*keys, "n", F.explode("ranks").alias("rank"), F.col("low").alias("x"))
        found = done if found is None else found.unionAll(done)
        left = bins.where("low <> high").select(*[F.col(k).alias(f"_{k}") for k in keys], "low", "high", "n", F.col("ahead").alias("before"), "ranks")
        if left.isEmpty():
            break
        if not keys:  # a row for each wanted rank at most
            left = F.broadcast(left)
        within = [F.col("x").between(F.col("low"), F.col("high")), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]]
        # only rows of bins that hold a wanted rank go on; bins of a group don't overlap
        rows = staged(rows.select(*keys, "x").join(left, reduce(lambda a, b: a & b, within)).drop(*[f"_{k}" for k in keys]), "values")
        share = (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))
        cell = [*keys, "before", "n"]
        finer = rows.groupBy(*cell, F.floor(share * BINS).alias("bin")).agg(*counts, F.first("ranks").alias("ranks"))
        bins = finer.withColumn("ahead", F.col("before") + ahead(Window.partitionBy(*cell))).drop("before")
    values = found.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    at = lambda r: F.element_at("at", r)
    between = lambda k: F.when(low[k] == high[k], at(low[k])).otherwise(at(low[k]) + (place[k] - low[k]) * (at(high[k]) - at(low[k])))
    return values.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *[between(k).alias(k) for k in wanted])


@registry.query(
    """SELECT o_orderstatus, round(median(o_totalprice), 6) AS med, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 6) AS q1,
              percentile_disc(0.75) WITHIN GROUP (ORDER BY o_totalprice) AS q3, percentile_disc(0.999) WITHIN GROUP (ORDER BY o_totalprice) AS high,
              min(o_totalprice) AS low FROM orders GROUP BY o_orderstatus"""
)
def quantiles_of_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"med": ("cont", 0.5), "q1": ("cont", 0.25), "q3": ("disc", 0.75), "high": ("disc", 0.999), "low": ("disc", 0.0)}
    found = exact_quantiles(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", wanted)
    return found.withColumns({c: F.round(c, 6) for c in ("med", "q1")})


@registry.query(
    """SELECT round(median(l_extendedprice), 6) AS price, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_extendedprice) AS high,
              round(percentile_cont(0.01) WITHIN GROUP (ORDER BY l_extendedprice), 6) AS low FROM lineitem"""
)
def quantiles_of_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"price": ("cont", 0.5), "high": ("disc", 0.9), "low": ("cont", 0.01)}
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), [], "l_extendedprice", wanted)
    return found.withColumns({c: F.round(c, 6) for c in ("price", "low")})


@registry.query(
    """SELECT source, round(median(n_chars), 6) AS med, round(percentile_cont(0.1) WITHIN GROUP (ORDER BY n_chars), 6) AS low,
              CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY n_chars) AS DOUBLE) AS high FROM documents GROUP BY source"""
)
def quantiles_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of texts by source, of which one may hold a third of all."""
    wanted = {"med": ("cont", 0.5), "low": ("cont", 0.1), "high": ("disc", 0.99)}
    found = exact_quantiles(table(spark, sf_dir, "documents"), ["source"], "n_chars", wanted)
    return found.withColumns({c: F.round(c, 6) for c in ("med", "low")})

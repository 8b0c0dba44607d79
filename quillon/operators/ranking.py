"""Row numbers and ranks of few, large groups, in many tasks.

A window over a group puts the whole group in one task. Here rows are dealt by ranges of (group, order), so that a group
lies in as many neighbouring partitions as it needs; a row's number is its place in its partition's part of the group
plus the rows of the group in earlier partitions, which a table of one row for each partition and group tells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.columns import temporary
from quillon.plans.registry import Registry
from quillon.session import table
from quillon.sources.shared import staged

registry = Registry()

#: Rows of one tie that meet in a task when ranks are looked up.
TIES = 4096


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality of columns, null equal to null."""
    return reduce(lambda x, y: x & y, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], number: str = "row_number", size: str | None = None, descending: Sequence[str] = ()) -> DataFrame:
    """df with each row's number, from 1, in its group `by`, and the group's rows as `size` if named.

    Nulls come first, or last in a descending column; a null key is a group of its own. Rows that are equal in `order`
    are numbered in any order, once and for all, as the sorted rows are written to the shared folder.
    """
    at, first, earlier, rows = (temporary(x, df) for x in ("at", "first", "earlier", "rows"))
    keys = [f"{at}_{i}" for i in range(len(by))]
    sorting = [F.col(c).asc_nulls_first() for c in by] + [F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_first() for c in order]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(partitions, *sorting).sortWithinPartitions(*sorting)
    found = staged(dealt.withColumn(at, F.monotonically_increasing_id()), "numbered")
    # the upper bits of the id are the partition's
    place = lambda d: F.shiftright(d[at], 33)
    parts = found.groupBy(place(found).alias(f"{at}_p"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.count(F.lit(1)).alias(rows), F.min(at).alias(first))
    group = Window.partitionBy(*keys)
    parts = parts.withColumn(earlier, F.coalesce(F.sum(rows).over(group.orderBy(f"{at}_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.withColumn(rows, F.sum(rows).over(group)).withColumnRenamed(first, f"{at}_f")
    on = place(found) == parts[f"{at}_p"]
    if by:
        on &= _same(found, parts, list(zip(by, keys, strict=True)))
    columns = [found[c] for c in df.columns] + [(found[at] - parts[f"{at}_f"] + 1 + parts[earlier]).alias(number)]
    return found.join(parts, on).select(*columns, *([parts[rows].alias(size)] if size else []))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], ties: Sequence[str] = (), tiles: int = 4, descending: Sequence[str] = ()) -> DataFrame:
    """df with row_number, rank, dense_rank, percent_rank, cume_dist and ntile (`tiles` of them) by `order` in each group.

    `ties` order rows of equal rank for row_number and ntile. A tie, however large, is looked up by blocks of TIES
    row numbers, so that no task holds one.
    """
    names = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
    if clash := {c.lower() for c in df.columns} & set(names):
        raise ValueError(f"df has columns of the results' names: {sorted(clash)}")
    size, low, high, block = (temporary(x, df) for x in ("size", "low", "high", "block"))
    rows = staged(numbered(df, by, [*order, *ties], "row_number", size, descending), "ranked")
    equal = rows.groupBy(*by, *order).agg(F.min("row_number").alias(low), F.max("row_number").alias(high))
    dense = numbered(equal, by, order, "dense_rank", descending=descending)
    spans = F.explode(F.sequence(F.floor(F.col(low) / TIES), F.floor(F.col(high) / TIES)))
    copied = dense.select(*[F.col(c).alias(f"{block}_{i}") for i, c in enumerate([*by, *order])], low, high, "dense_rank", spans.alias(block))
    on = (F.floor(rows["row_number"] / TIES) == copied[block]) & _same(rows, copied, [(c, f"{block}_{i}") for i, c in enumerate([*by, *order])])
    n, k, whole, more = F.col(size), F.col("row_number"), F.floor(F.col(size) / tiles), F.col(size) % tiles
    # the first tiles are a row larger
    tile = F.when(k <= more * (whole + 1), F.floor((k - 1) / (whole + 1))).otherwise(more + F.floor((k - 1 - more * (whole + 1)) / F.greatest(whole, F.lit(1)))) + 1
    return rows.join(copied, on).select(
        *[rows[c] for c in df.columns], "row_number", F.col(low).alias("rank"), "dense_rank", F.when(n > 1, (F.col(low) - 1) / (n - 1)).otherwise(0.0).alias("percent_rank"),
        (F.col(high) / n).alias("cume_dist"), tile.cast("long").alias("ntile"),
    )


@registry.query(
    """SELECT o_orderkey, row_number() OVER (w ORDER BY o_orderdate, o_orderkey) AS row_number, rank() OVER (w ORDER BY o_orderdate) AS rank,
              dense_rank() OVER (w ORDER BY o_orderdate) AS dense_rank, round(percent_rank() OVER (w ORDER BY o_orderdate), 8) AS percent_rank,
              round(cume_dist() OVER (w ORDER BY o_orderdate), 8) AS cume_dist, ntile(7) OVER (w ORDER BY o_orderdate, o_orderkey) AS ntile
       FROM orders WINDOW w AS (PARTITION BY o_orderstatus)"""
)
def ranks_of_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups, and many orders of one date: as window functions would rank them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    found = ranked(orders, ["o_orderstatus"], ["o_orderdate"], ["o_orderkey"], 7)
    rounded = [F.round(c, 8).alias(c) for c in ("percent_rank", "cume_dist")]
    return found.select("o_orderkey", "row_number", "rank", "dense_rank", *rounded, "ntile")


@registry.query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events")
def numbers_of_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return numbered(events, ["event_type"], ["value", "event_id"], "place", descending=["value"]).drop("value")


@registry.query(
    """SELECT doc_id, row_number() OVER (w ORDER BY n_chars, doc_id) AS row_number, rank() OVER (w ORDER BY n_chars) AS rank, dense_rank() OVER (w ORDER BY n_chars) AS dense_rank,
              round(percent_rank() OVER (w ORDER BY n_chars), 8) AS percent_rank, round(cume_dist() OVER (w ORDER BY n_chars), 8) AS cume_dist,
              ntile(100) OVER (w ORDER BY n_chars, doc_id) AS ntile FROM documents WINDOW w AS (PARTITION BY source)"""
)
def ranks_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by length within their source, of which one may hold a third of all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    found = ranked(docs, ["source"], ["n_chars"], ["doc_id"], 100)
    rounded = [F.round(c, 8).alias(c) for c in ("percent_rank", "cume_dist")]
    return found.select("doc_id", "row_number", "rank", "dense_rank", *rounded, "ntile")

"""Helpers shared by the training-data operators: table access, shared staging, column handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: space and U+0009 to U+000D (fixed by the word definition `[^\x20\x09-\x0D]+`).
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of one key that one task may meet in a join, and how many hot keys there can be, whatever the input.
HOT_ROWS, HOT_KEYS = 500, 100_000

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, facts: DataFrame, key: str, by: str, also: Column | None = None, sizes: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """Inner join of rows and facts on key (and the condition also), where hot keys have their rows dealt to many tasks.

    A key is hot with more rows than HOT_ROWS, or than rows / HOT_KEYS where that would be too many, so
    their list has HOT_KEYS entries at most, whatever the input, and can be broadcast. A hot key's rows are
    salted by the column `by`, its facts are repeated for each salt. sizes (key, rows), if known, spares counting.
    merge: rows are shuffled at every size, instead of where facts are too many to be sent to them.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")) if sizes is None else sizes
    limit = HOT_ROWS
    hot = sizes.where(F.col("rows") > limit).limit(HOT_KEYS + 1).collect()
    if len(hot) > HOT_KEYS:
        limit = max(HOT_ROWS, -(-sizes.agg(F.sum("rows")).first()[0] // HOT_KEYS))
        hot = sizes.where(F.col("rows") > limit).collect()
    both = lambda r, f, on: (r.hint("merge") if merge else r).join(f, on)
    joined = lambda r, f, on: both(r, f, on) if also is None else both(r, f, on).where(also)
    if not hot:
        return joined(rows, facts, key)
    salts = F.broadcast(rows.sparkSession.createDataFrame([(r[key], -(-r["rows"] // limit)) for r in hot], f"{key} {rows.schema[key].dataType.simpleString()}, salts long"))
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(by), F.col("salts"))).otherwise(0)
    dealt = rows.join(salts, key, "left").withColumn("salt", salt).drop("salts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1))
    repeated = facts.join(salts, key, "left").withColumn("salt", copies).drop("salts")
    return joined(dealt, repeated, [key, "salt"]).drop("salt")


def mix64(h: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit hashes, one to one."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The text column as a string, null read as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def plain_spaces(text: Column, *also: str) -> Column:
    """text with U+0009 and U+000B to U+000D, and the characters given, made spaces: one for one, without regular expressions."""
    for c in ("\t", "\x0b", "\x0c", "\r", *also):
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    return F.array_remove(F.split(plain_spaces(text, "\n"), " "), "")


def temporary(docs: DataFrame, stem: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held(df: DataFrame, *keys: str) -> DataFrame:
    """df with its other columns computed in one place, once a row.

    A filter above would otherwise be pushed into the expressions they are made of and evaluate
    them again, inside lambdas even for each element. A generator of one row stops that.
    """
    made = [c for c in df.columns if c not in keys]
    name = temporary(df, "held")
    d = df.select(*keys, F.explode_outer(F.array(F.struct(*made))).alias(name))
    return d.select(*keys, *[F.col(name)[c].alias(c) for c in made]).select(df.columns)

"""Which texts contain which items of a list, such as passages of a benchmark: an index instead of a nested loop.

An item's inner words, all but its first and last piece, stand as whole words in any text that contains it. So each item is
looked up by the rarest of its inner word n-grams, counted over all texts, and only texts that hold that n-gram are compared
with it, as substrings. Items without an inner word are looked up by their longest piece among the distinct words (or runs
of white space) of all texts, which are indexed by three characters for that. Both ways lose nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.columns import bound
from quillon.plans.registry import Registry
from quillon.session import table
from quillon.sources.shared import staged

registry = Registry()

#: Words of an n-gram (fewer for items that have fewer), and characters by which words are indexed for very short items.
WORDS, LETTERS = 5, 3

_SPACE = r"[ \t\n\x0B\f\r]+"


def _pieces(text: Column) -> Column:
    return F.split(text, _SPACE, -1)


def _grams(words: Column, size: int | Column) -> Column:
    """Hashes of the n-grams of so many words."""
    k = F.lit(size) if isinstance(size, int) else size
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(k.cast("int"), F.slice(w, i, k)))
    return bound(words, lambda w: F.when(F.size(w) >= k, each(w)).otherwise(F.array().cast("array<bigint>")))


def _parts(text: Column, size: int) -> Column:
    """Distinct substrings of so many characters."""
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _by_words(texts: DataFrame, items: DataFrame) -> DataFrame | None:
    """(id, key) that may be contained, for items (key, item, inner) with inner words; None without such items."""
    sized = items.where(F.size("inner") > 0).select("key", "inner", F.least(F.size("inner"), F.lit(WORDS)).alias("k"))
    sizes = sorted(r[0] for r in sized.select("k").distinct().collect())  # WORDS numbers at most
    if not sizes:
        return None
    wanted = staged(sized.select("key", F.explode(F.array_distinct(_grams(F.col("inner"), F.col("k")))).alias("h")), "grams")
    every = texts.select("id", F.explode(F.array_distinct(bound(_pieces(F.col("text")), lambda w: F.concat(*[_grams(w, k) for k in sizes])))).alias("h"))
    # of all texts' n-grams only those go on that some item has: Spark sends the list to the texts where it is small
    held = staged(every.join(wanted.select("h").distinct(), "h", "left_semi").distinct(), "held")
    counts = held.groupBy("h").agg(F.count(F.lit(1)).alias("texts"))
    rarest = wanted.join(counts, "h", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "h")).alias("x"))
    return held.join(rarest.where("x.texts > 0").select("key", F.col("x.h").alias("h")), "h").select("id", "key")


def _by_letters(texts: DataFrame, items: DataFrame) -> DataFrame | None:
    """(id, key) that may be contained, for items without inner words; None without such items."""
    longest = F.reduce("pieces", F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    short = items.where((F.size("inner") == 0) & (F.length("item") > 0)).withColumn("needle", longest)
    short = short.withColumn("needle", F.when(F.length("needle") > 0, F.col("needle")).otherwise(F.col("item")))  # white space alone
    sizes = sorted(r[0] for r in short.select(F.least(F.length("needle"), F.lit(LETTERS))).distinct().collect())  # LETTERS numbers at most
    if not sizes:
        return None
    first = short.select("key", "needle", F.substring("needle", 1, LETTERS).alias("part"))
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(rf"{_SPACE}|[^{_SPACE[1:-2]}]+"), F.lit(0)))
    held = staged(texts.select("id", F.explode(runs).alias("run")), "runs")
    parts = held.select("run").distinct().select("run", F.explode(F.concat(*[_parts(F.col("run"), n) for n in sizes])).alias("part"))
    found = parts.join(first, "part").where(F.contains("run", "needle")).select("run", "key")
    return held.join(found, "run").select("id", "key")


def contained(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", item_text: str = "text") -> DataFrame:
    """doc_id and item_id of each pair of rows where the text contains the item, as `contains` would join them.

    Null texts and items are in no pair; the empty item is in every text. Rows of equal or null ids are compared each.
    """
    texts = docs.select(docs[doc_id].alias("id"), docs[text].cast("string").alias("text")).where("text IS NOT NULL")
    rows = items.select(items[item_id].alias("item_id"), items[item_text].cast("string").alias("item")).where("item IS NOT NULL")
    rows = staged(rows.withColumn("key", F.sha2("item", 256)), "items")
    pieces = _pieces(F.col("item"))
    distinct = rows.select("key", "item").distinct().withColumn("pieces", pieces)
    distinct = staged(distinct.withColumn("inner", F.when(F.size("pieces") > 2, F.slice("pieces", F.lit(2), F.size("pieces") - 2)).otherwise(F.array().cast("array<string>"))), "items")
    found = [x for x in (_by_words(texts, distinct), _by_letters(texts, distinct)) if x is not None]
    out = texts.join(rows.where("item = ''"), F.lit(True)).select("id", "item_id") if not rows.where("item = ''").isEmpty() else None
    for candidates in found:
        pairs = candidates.distinct().join(distinct.select("key", "item"), "key").withColumnRenamed("id", "_id")
        sure = texts.join(pairs, F.col("id").eqNullSafe(F.col("_id"))).where(F.contains("text", "item")).select("id", "key")
        sure = sure.join(rows.select("key", "item_id"), "key").select("id", "item_id")
        out = sure if out is None else out.unionAll(sure)
    if out is None:
        out = texts.join(rows, F.lit(False)).select("id", "item_id")
    return out.select(F.col("id").alias(doc_id), F.col("item_id").alias(item_id))


@registry.query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def text_contains_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@registry.query("SELECT p.page_id, n.n_nationkey FROM pages p JOIN (SELECT n_nationkey, split_part(n_name, '_', 2) AS part FROM nation) n ON contains(p.html, n.part)")
def text_contains_short_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a digit or two, which stand inside of words."""
    items = table(spark, sf_dir, "nation").select("n_nationkey", F.split_part("n_name", F.lit("_"), F.lit(2)).alias("part"))
    return contained(table(spark, sf_dir, "pages"), items, "page_id", "n_nationkey", "html", "part")

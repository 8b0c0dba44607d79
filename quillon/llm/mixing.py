"""Mixing sources to target weights, on DataFrame functions only.

The words of each source are packed, in a fixed order of its documents, into blocks of a fixed
length. Output shards of a fixed number of slots draw their sources: each slot is an independent draw
by the sources' shares, so a shard's counts are multinomial. Correction: over all shards a source may
have drawn more or fewer slots than its target; the surplus, spread evenly over a source's slots, goes
to the sources that lack slots, which moves a share of slots of the order of the draw's error and makes
each source's total exact to a block. A source's slots, counted over the shards, run through
pseudorandom permutations of its block numbers, one permutation a pass; blocks are then joined by
source and number.

A source with a third of all rows is no hot spot: its order is cut into salted chunks, whose totals
are summed first; a window sees one chunk, the list of chunks of one source, one group of shards or the
groups of shards of one source. Only the list of sources itself, a row each, is ordered in one task.
Everything else has a row per source and shard, per block, or per document and block.

Defined results: a null text has size 0 and is never taken; a null source is one source, ordered
last; no document is taken more than 3 times; repeated rows and rows of a null id are separate documents
in a fixed order; a source without words has target 0; no rows give no rows; extra columns are ignored
by `taken` and carried along by `mixed`; texts of any length are cut at blocks. The same input gives the
same mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import staged, temporary, text_of, words


@dataclass(frozen=True)
class Mixture:
    #: Weights by rank of the source, repeating.
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    #: How often a source may be used at most.
    passes: int = 3
    block_words: int = 64
    shard_slots: int = 4096
    #: Chunks of a source's order, and how many chunks or shards are summed at a time: a window holds so many rows, or a chunk.
    chunks: int = 1 << 14
    chunk_group: int = 128
    shard_group: int = 1024
    #: Cells of the unit interval in which a draw looks up its source.
    cells: int = 1024
    seed: int = 29


def _unit(*parts: Column) -> Column:
    """A number in (0, 1) made from a hash of parts."""
    return (F.call_function("shiftrightunsigned", F.xxhash64(*parts), F.lit(11)).cast("double") + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, mix: Mixture) -> DataFrame:
    """sizes (source, source_size: a row a source) with target: weighted shares of the total, capped and reshared.

    The capped sources are those with the lowest cap per weight, so one pass in that order finds the
    level at which no target is above its cap.
    """
    # a row a source, already summed: these windows hold the list of sources, not documents
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in mix.weights]), (((F.row_number().over(order) - 1) % len(mix.weights)) + 1).cast("int"))
    d = sizes.withColumn("weight", w).withColumn("cap", mix.passes * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    all_rows = Window.partitionBy()
    below = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("level", (F.sum("source_size").over(all_rows) - below) / weight_left)
    # the first source whose cap holds at its level ends the capped ones
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_rows)
    d = d.withColumn("free", free["level"])
    return d.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("free") * F.col("weight"), F.col("cap"))).alias("target"))


def _gcd_step(n: Column, *parts: Column) -> Column:
    """A multiplier without common factor with n: one of the primes above 2^30, of which at most two can divide n < 2^60."""
    # fixed values: primes
    primes = [1073741827, 1073741831, 1073741833, 1073741839, 1073741843, 1073741857, 1073741891, 1073741909]
    fit = F.filter(F.array(*[F.lit(p) for p in primes]), lambda p: n % p != 0)
    return F.element_at(fit, (F.pmod(F.xxhash64(*parts), F.size(fit)) + 1).cast("int"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """index in [0, n) through a permutation of [0, n) that key chooses: affine steps on both sides of a reversal.

    Products are made in 38 digits, so n may be as large as 2^60.
    """
    a, b = _gcd_step(n, *key, F.lit(1)), F.pmod(F.xxhash64(*key, F.lit(2)), n)
    c, d = _gcd_step(n, *key, F.lit(3)), F.pmod(F.xxhash64(*key, F.lit(4)), n)
    wide = lambda x: x.cast("decimal(19,0)")
    step = lambda x, times, plus: F.pmod(wide(x) * wide(times % n) + wide(plus), wide(n)).cast("long")
    once = step(index, a, b)
    # swap odd and even positions in the lower part, then a second affine step
    odd = F.when(once < n - n % 2, once.bitwiseXOR(F.lit(1).cast("long"))).otherwise(once)
    return step(odd, c, d)


def _sum_before(rows: DataFrame, order: str, group: int, value: str, out: str) -> DataFrame:
    """rows (s, order, value) with the sum of value over the smaller orders of the same s, by sums of two levels."""
    rows = rows.withColumn("group", F.floor(F.col(order) / group))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = rows.groupBy("s", "group").agg(F.sum(value).alias("all"))
    heads = heads.select("s", "group", before("all", Window.partitionBy("s").orderBy("group")).alias("head"))
    inside = rows.withColumn("inside", before(value, Window.partitionBy("s", "group").orderBy(order)))
    return inside.join(heads, ["s", "group"]).withColumn(out, F.col("head") + F.col("inside")).drop("group", "head", "inside")


def draw(docs: DataFrame, mix: Mixture = Mixture()) -> tuple[DataFrame, DataFrame]:
    """(documents, slots).

    documents: row (a number of the row), doc_id, source, size, start (its first word's place in the
    source's order), source_size, target. slots: shard, slot, source, pass, block: the mix itself.
    """
    size = F.size(words(text_of(docs))).cast("long")
    d = docs.select(
        docs["doc_id"], docs["source"].cast("string").alias("source"), size.alias("size"),
        F.xxhash64(docs["text"].cast("string")).alias("tie"),
    )
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(mix.seed)), F.lit(mix.chunks)).cast("int"))
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    d = staged(d.withColumn("s", key.cast("struct<n:boolean,v:string>")), "sizes")  # words are counted once
    totals = d.groupBy("s", "source", "chunk").agg(F.sum("size").alias("chunk_size"))
    sizes = totals.groupBy("s", "source").agg(F.sum("chunk_size").alias("source_size"))
    plan = targets(sizes.select("source", "source_size"), mix)
    plan = staged(plan.withColumn("s", key.cast("struct<n:boolean,v:string>")).drop("source"), "plan")  # a row a source
    heads = _sum_before(totals.select("s", "chunk", "chunk_size"), "chunk", mix.chunk_group, "chunk_size", "chunk_start").drop("chunk_size").join(plan, "s")
    inner = F.sum("size").over(
        Window.partitionBy("s", "chunk").orderBy(F.xxhash64("doc_id", F.lit(mix.seed + 1)), "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = d.withColumn("in_chunk", F.coalesce(inner, F.lit(0))).join(heads, ["s", "chunk"])
    placed = placed.select("doc_id", "s", "size", "tie", (F.col("chunk_start") + F.col("in_chunk")).alias("start"), "source_size", "target")
    return placed, _slots(plan, mix)


def _slots(plan: DataFrame, mix: Mixture) -> DataFrame:
    """shard, slot, s, pass, block from the sources' sizes and targets."""
    spark = plan.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # windows over the list of sources, a row each
    ordered = Window.orderBy("s")
    upto, earlier = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, -1)
    b = plan.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / mix.block_words))
    b = b.withColumn("wanted", F.col("target") / F.col("source_size") * F.col("blocks"))
    b = b.withColumn("to", F.sum("wanted").over(upto)).withColumn("all", F.sum("wanted").over(Window.partitionBy()))
    whole = lambda x: F.floor(x + 0.5)
    b = b.withColumn("due", whole(F.col("to")) - whole(F.coalesce(F.lag("to").over(ordered), F.lit(0.0))))  # adds up to all, rounded
    low = F.coalesce(F.lag("to").over(ordered), F.lit(0.0)) / F.col("all")
    high = F.when(F.lead("to").over(ordered).isNull(), F.lit(2.0)).otherwise(F.col("to") / F.col("all"))
    b = staged(b.select("s", "blocks", "due", low.alias("low"), high.alias("high")), "shares")
    slots = b.agg(F.sum("due")).first()[0] or 0
    shards = max(1, -(-slots // mix.shard_slots))

    # the draw: a shard's slots are numbers in (0, 1), each of which lies in one source's share
    cell = lambda x: F.floor(x * mix.cells)
    edges = b.select("s", "low", "high", F.explode(F.sequence(cell(F.col("low")), F.least(cell(F.col("high")), F.lit(mix.cells - 1)))).alias("cell"))
    shard = spark.range(0, shards, 1, min(shards, partitions)).withColumnRenamed("id", "shard")
    shard = shard.withColumn("n", F.lit(slots // shards) + (F.col("shard") < slots % shards).cast("long")).where("n > 0")
    drawn = shard.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    drawn = drawn.withColumn("u", _unit(F.col("shard"), F.col("i"), F.lit(mix.seed))).withColumn("cell", cell(F.col("u")))
    hit = drawn.join(edges, "cell").where("u >= low AND u < high")  # broadcast by Spark's own size check, merged beyond it
    counts = staged(hit.groupBy("s", "shard").agg(F.count(F.lit(1)).alias("n")), "counts")

    # the correction: sources that drew too many give spare slots to those that drew too few
    total = F.coalesce("total", F.lit(0))
    even = b.join(counts.groupBy("s").agg(F.sum("n").alias("total")), "s", "left").select("s", "blocks", "due", total.alias("total"))
    even = even.withColumn("spare", F.greatest(F.col("total") - F.col("due"), F.lit(0))).withColumn("lack", F.greatest(F.col("due") - F.col("total"), F.lit(0)))
    since = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    even = even.withColumn("spare_from", since("spare")).withColumn("lack_from", since("lack"))
    wanting = even.where("lack > 0").select(
        F.col("s").alias("to_s"), F.col("blocks").alias("to_blocks"), (F.col("total") - F.col("lack_from")).alias("shift"),
        F.explode(F.sequence(F.col("lack_from"), F.col("lack_from") + F.col("lack") - 1)).alias("number"),
    )

    # a source's slots are numbered over the shards by sums of two levels
    grid = _sum_before(counts, "shard", mix.shard_group, "n", "first")
    in_shard = F.sum("n").over(Window.partitionBy("shard").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.withColumn("slot", F.coalesce(in_shard, F.lit(0))).select("s", "shard", "n", "first", "slot").join(even.drop("due", "lack", "lack_from"), "s")
    grid = grid.repartition(partitions, "s", "shard")  # a source's slots are made by as many tasks as it has shards
    j = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j")
    numbered = grid.select("s", "shard", "blocks", "spare", "total", "spare_from", (F.col("slot") - F.col("first")).alias("slot"), j).withColumn("slot", F.col("slot") + F.col("j"))
    given = lambda j: F.expr(f"CAST({j} AS DECIMAL(19,0)) * CAST(spare AS DECIMAL(19,0)) DIV CAST(total AS DECIMAL(19,0))")
    numbered = numbered.withColumn("given", F.when(F.col("spare") > 0, given("j")).otherwise(0)).withColumn(
        "gives", F.when(F.col("spare") > 0, given("(j + 1)") > F.col("given")).otherwise(F.lit(False))
    )
    kept = numbered.where("NOT gives").select("s", "shard", "slot", "blocks", (F.col("j") - F.col("given")).alias("i"))
    moved = numbered.where("gives").withColumn("number", F.col("spare_from") + F.col("given")).join(wanting, "number")
    moved = moved.select(F.col("to_s").alias("s"), "shard", "slot", F.col("to_blocks").alias("blocks"), (F.col("number") + F.col("shift")).alias("i"))
    # what rounding gives beyond the last pass is dropped: at most one slot a source
    taken = kept.unionAll(moved).where(F.col("i") < mix.passes * F.col("blocks"))
    taken = taken.select("s", "shard", "slot", "blocks", F.floor(F.col("i") / F.col("blocks")).alias("pass"), (F.col("i") % F.col("blocks")).alias("i"))
    block = permuted(F.col("i"), F.col("blocks"), F.col("s"), F.col("pass"), F.lit(mix.seed))
    return taken.select("s", "shard", "slot", "pass", block.alias("block"))


def _block_parts(placed: DataFrame, mix: Mixture) -> DataFrame:
    """A row per document and block that holds words of it: block, and the words' begin and end within the document."""
    n = F.lit(mix.block_words)
    span = F.sequence(F.floor(F.col("start") / n), F.floor((F.col("start") + F.col("size") - 1) / n))
    d = placed.where("size > 0").select("doc_id", "tie", "s", "size", "start", F.explode(span).alias("block"))
    begin = F.greatest(F.col("block") * n - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * n - F.col("start"), F.col("size"))
    return d.select("doc_id", "tie", "s", "size", "start", "block", begin.alias("begin"), end.alias("end"))


def taken(docs: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    placed, slots = draw(docs, mix)
    uses = slots.groupBy("s", "block").agg(F.count(F.lit(1)).alias("uses"))
    per_doc = (
        _block_parts(placed, mix).hint("merge").join(uses.hint("merge"), ["s", "block"])  # both grow with the input
        .groupBy("s", "doc_id", "start").agg(F.sum((F.col("end") - F.col("begin")) * F.col("uses")).alias("taken"))
    )
    # size 0 documents share a start with the next one, and take nothing
    per_doc = per_doc.withColumnRenamed("s", "s2").withColumnRenamed("doc_id", "id2").withColumnRenamed("start", "start2")
    same = (placed["s"] == per_doc["s2"]) & placed["doc_id"].eqNullSafe(per_doc["id2"]) & (placed["start"] == per_doc["start2"]) & (placed["size"] > 0)
    d = placed.hint("merge").join(per_doc.hint("merge"), same, "left")
    return d.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """The mix as rows with the columns of docs: one for each document and pass that takes words of it.

    A document that a pass takes whole keeps its text; else its text is the words taken, in order.
    n_chars, where docs has it, is the length of the new text.
    """
    placed, slots = draw(docs, mix)
    picks = _block_parts(placed, mix).hint("merge").join(slots.select("s", "block", "pass").hint("merge"), ["s", "block"])
    picks = picks.groupBy("s", "doc_id", "tie", "start", "size", "pass").agg(
        F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("parts"), F.sum(F.col("end") - F.col("begin")).alias("n")
    )
    # rows of equal id and text are one another's copies: their picks are dealt out among them by rank
    tie, place = temporary(docs, "tie"), temporary(docs, "place")
    p_id, p_tie, p_place, value, null, parts, n, size = (temporary(docs, f"picked_{x}") for x in ("id", "tie", "place", "value", "null", "parts", "n", "size"))
    twin = F.row_number().over(Window.partitionBy("s", "doc_id", "tie", "pass").orderBy("start"))
    picks = picks.select(
        F.col("doc_id").alias(p_id), F.col("tie").alias(p_tie), twin.alias(p_place), F.col("s")["v"].alias(value), F.col("s")["n"].alias(null),
        F.col("parts").alias(parts), F.col("n").alias(n), F.col("size").alias(size),
    )
    base = docs.withColumn(tie, F.xxhash64(docs["text"].cast("string")))
    base = base.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", tie, "source").orderBy("doc_id")))
    same = (
        base["doc_id"].eqNullSafe(F.col(p_id)) & (F.col(tie) == F.col(p_tie)) & (F.col(place) == F.col(p_place))
        & (F.coalesce(base["source"].cast("string"), F.lit("")) == F.col(value)) & (base["source"].isNull() == F.col(null))
    )
    # a cut text is split once, before its parts are sliced: within their lambda it would be split for each of them
    found = temporary(docs, "words")
    d = base.join(picks, same)
    d = d.withColumn(found, F.explode_outer(F.array(F.when(F.col(n) < F.col(size), words(text_of(base))))))
    cut = F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(found, (p["begin"] + 1).cast("int"), (p["end"] - p["begin"]).cast("int")))), " ")
    text = F.when(F.col(n) < F.col(size), cut).otherwise(base["text"])
    out = [F.length(text).cast("long").alias(c) if c == "n_chars" else text.alias(c) if c == "text" else base[c] for c in docs.columns]
    return d.select(*out)

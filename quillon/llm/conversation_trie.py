"""The trie of conversation prefixes, by prefix doubling.

1. Turns are numbered within their conversation by ranges, not by a window, so a conversation of any length lies in many
   tasks. From here on a turn is the digest of its role and text (SHA-256, taken as one to one) and the size of its text.
2. Blocks of 1, 2, 4, ... turns that begin at multiples of their length get dense names, equal blocks equal ones: a block's
   name is that of the pair of its halves. Each round has half the rows of the one before.
3. A prefix of d turns is made of such blocks by the binary digits of d. So prefixes are named from the longest blocks
   down: by the pair of the prefix without its last block, which has a name already, and that block. A prefix name is a node.
4. Nodes are grouped by name. What sums over subtrees is taken along conversations: a node belongs to its smallest
   conversation, so each conversation holds the end of one path, and a subtree is the ends that its members hold at or below
   it. Sums from each depth down, in two levels, give every member's share; the node adds them.

The rounds are two logarithms of the longest conversation; all else is joins and sums of a row for each turn.
Hot groups: equal turns, pairs and prefixes that very many conversations share are counted by partial sums, and joined
with their names by dealing a hot name's rows to many tasks (`common.spread`). A node's conversations are joined to text by
chunks of at most `ENDS` ids and hashed as a stream. The driver holds the rows of each partition when names are numbered,
a number a partition, and the longest length. Tables in the shared folder cut lineage.

Defined results: null roles and texts are empty; null turns come first; turns of one number come in the order of role, then
of digest, and repeated rows are turns each. Rows of a null conv_id are in no conversation. Texts and conversations of any
length are taken whole; an empty table has no conversation and gives no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import spread, staged
from quillon.operators.ranking import numbered

#: Conversations whose ids are joined in one text, and depths that are summed in one place, at most.
ENDS, DEPTHS = 4096, 1024


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turns (of the conversation), digest and n_bytes of each turn."""
    empty = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(""))
    role, text = empty("role"), empty("text")
    # the role's length tells it from the text
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return numbered(rows.where("conv_id IS NOT NULL"), ["conv_id"], ["turn", "role", "digest"], "pos", "turns").drop("turn", "role")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (turns (c, pos, digest, n_bytes), lengths (c, length)).

    The first h turns of a conversation c are those of c - c % 5, as far as it has them; h is a checksum of c.
    """
    known = staged(rows.groupBy("conv_id").agg(F.max("turns").alias("turns")), "conversations")
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % 9
    own = known.select(c, F.col("turns"), h.alias("h"), (c - c % 5).alias("parent"))
    lent = F.least("h", F.coalesce("lends", F.lit(0).cast("long")))
    plan = own.join(known.select(c.alias("parent"), F.col("turns").alias("lends")), "parent", "left").select("conv_id", "parent", "h", "turns", lent.alias("lent"))
    plan = staged(plan, "plan")
    rest = spread(rows.select("conv_id", "pos", "digest", "n_bytes"), plan.select("conv_id", "h", "lent"), "conv_id", "pos", sizes=plan.select("conv_id", F.col("turns").alias("rows")))
    rest = rest.where("pos > h").select(F.col("conv_id").alias("c"), (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "digest", "n_bytes")
    # eight turns at most, for five conversations at most
    first = rows.where((F.col("pos") <= 8) & (F.col("conv_id") % 5 == 0)).select(F.col("conv_id").alias("parent"), "pos", "digest", "n_bytes")
    lent_rows = first.join(plan.select(F.col("conv_id").alias("c"), "parent", "lent"), "parent").where("pos <= lent").select("c", "pos", "digest", "n_bytes")
    lengths = plan.select(F.col("conv_id").alias("c"), (F.col("lent") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length"))
    return staged(lent_rows.unionAll(rest), "turns"), staged(lengths, "lengths")


def _names(rows: DataFrame, base: int) -> tuple[DataFrame, int]:
    """((key, rows, name) for each distinct key of rows, the number of names): names are base, base + 1, ..."""
    distinct = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).withColumn("at", F.monotonically_increasing_id()), "names")
    part = F.shiftright("at", 33)
    counts = sorted(tuple(r) for r in distinct.groupBy(part.alias("part")).count().collect())  # a row a partition
    ahead, offsets = base, []
    for number, n in counts:
        offsets.append((number, ahead))
        ahead += n
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part long, ahead long"))
    name = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("ahead")
    return distinct.withColumn("part", part).join(known, "part").select("key", "rows", name.alias("name")), ahead - base


def _named(rows: DataFrame, base: int) -> tuple[DataFrame, int]:
    """rows (c, at, key) with a dense name for the key: (c, at, name), and the number of names."""
    names, n = _names(rows, base)
    dealt = rows.withColumn("deal", F.xxhash64("c", "at"))
    return staged(spread(dealt, names.select("key", "name"), "key", "deal", sizes=names.select("key", "rows")).select("c", "at", "name"), "named"), n


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b")).alias("key")


def prefix_names(turns: DataFrame) -> DataFrame:
    """(c, depth, name) of every prefix of one turn or more; equal names, equal prefixes. turns: (c, pos, digest)."""
    longest = turns.agg(F.max("pos")).first()[0]
    if longest is None:
        return turns.sparkSession.createDataFrame([], "c long, depth long, name long")
    block, _ = _named(turns.select("c", (F.col("pos") - 1).alias("at"), F.col("digest").alias("key")), 0)
    blocks = [block]
    while 2 ** len(blocks) <= longest:
        half = F.when(F.col("at") % 2 == 0, F.col("name")), F.when(F.col("at") % 2 == 1, F.col("name"))
        pairs = blocks[-1].groupBy("c", F.expr("at DIV 2").alias("half")).agg(F.max(half[0]).alias("x"), F.max(half[1]).alias("y"))
        whole = pairs.where("x IS NOT NULL AND y IS NOT NULL").select("c", F.col("half").alias("at"), _pair(F.col("x"), F.col("y")))
        blocks.append(_named(whole, 0)[0])
    known, base = None, 1  # zero is the root's name
    for k in reversed(range(len(blocks))):
        size = 2**k
        last = blocks[k].where("at % 2 = 0").select("c", (F.col("at") * size).alias("depth"), F.col("name").alias("block"))
        if known is None:
            before = last.withColumn("name", F.lit(0).cast("long"))
        else:
            before = last.join(known, ["c", "depth"], "left").withColumn("name", F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.col("name")))
        named, n = _named(before.select("c", (F.col("depth") + size).alias("at"), _pair(F.col("name"), F.col("block"))), base)
        base += n
        named = named.select("c", F.col("at").alias("depth"), "name")
        known = named if known is None else known.unionAll(named)
    return known


def ends(places: DataFrame) -> DataFrame:
    """(name, ends_sha256): the digest of the ids c of places (name, c), ascending and joined by commas.

    Names of few ids are hashed at once; others as a stream of chunks, of which a task holds one.
    """
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",")
    parts = staged(places.groupBy("name", F.floor(F.col("c") / ENDS).alias("chunk")).agg(joined.alias("ids")), "ends")
    counts = parts.groupBy("name").agg(F.count(F.lit(1)).alias("chunks"), F.min("chunk").alias("chunk"))
    one = parts.join(counts.where("chunks = 1").select("name", "chunk"), ["name", "chunk"]).select("name", F.sha2("ids", 256).alias("ends_sha256"))
    many = counts.where("chunks > 1").select("name")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        told = lambda: pa.RecordBatch.from_pydict({"name": pa.array([name], pa.int64()), "ends_sha256": pa.array([digest.hexdigest()])})
        for batch in batches:
            for at, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != name:
                    if digest is not None:
                        yield told()
                    name, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if digest is not None:
            yield told()

    sorted_parts = parts.join(many, "name", "left_semi").repartition("name").sortWithinPartitions("name", "chunk").select("name", "ids")
    return one.unionAll(sorted_parts.mapInArrow(stream, "name long, ends_sha256 string"))


def _below(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with each of columns replaced by its sum over the conversation's rows at this depth and deeper."""
    chunk = F.floor(F.col("depth") / DEPTHS)
    rows = rows.withColumn("chunk", chunk)
    deeper = Window.partitionBy("c").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("c", "chunk").agg(*[F.sum(x).alias(x) for x in columns])
    chunks = chunks.select("c", "chunk", *[F.coalesce(F.sum(x).over(deeper), F.lit(0)).alias(f"{x}_after") for x in columns])
    within = Window.partitionBy("c", "chunk").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("c", "depth", "name", "chunk", *[F.sum(x).over(within).alias(x) for x in columns])
    return summed.join(chunks, ["c", "chunk"]).select("c", "depth", "name", *[(F.col(x) + F.col(f"{x}_after")).alias(x) for x in columns])


def nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """name, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    turns: (c, pos, digest, n_bytes), pos from 1 without gaps; lengths: (c, length), conversations without turns included.
    """
    named = prefix_names(turns)
    told = turns.select("c", F.col("pos").alias("depth"), "n_bytes")
    deep = named.join(told, ["c", "depth"])
    root = lengths.select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("n_bytes"))
    places = staged(deep.select("c", "depth", "name", "n_bytes").unionAll(root), "places")
    last = lengths.select("c", F.col("length").alias("depth"), F.lit(1).alias("end"))
    placed = staged(places.join(last, ["c", "depth"], "left").withColumn("end", F.coalesce("end", F.lit(0))), "places")
    stats = placed.groupBy("name").agg(F.min("c").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.sum("end").alias("n_ends"), F.max("n_bytes").alias("n_bytes"))
    stats = staged(stats, "stats")
    facts = stats.select("name", "conv_id", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saves"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"))
    dealt = placed.select("c", "depth", "name", F.xxhash64("c", "depth").alias("deal"))
    known = staged(spread(dealt, facts, "name", "deal", sizes=stats.select("name", F.col("n_convs").alias("rows"))).drop("deal"), "known")
    own = F.col("conv_id") == F.col("c")
    shares = known.select("c", "depth", "name", F.when(own, F.col("saves")).otherwise(0).alias("saved"), F.when(own, F.col("leaf")).otherwise(0).alias("leaves"))
    sums = _below(shares, "saved", "leaves").groupBy("name").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    # a node's parent lies one step up on the path of its own conversation
    above = known.select("c", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = staged(known.where(own).select("c", "depth", "name").join(above, ["c", "depth"]).select("name", "parent", "parent_conv_id"), "parents")
    children = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "name")
    found = stats.join(sums, "name").join(parents.drop("parent"), "name", "left").join(children, "name", "left").join(ends(placed.where("end = 1").select("name", "c")), "name", "left")
    return found.select(
        "name", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """`nodes` of the conversations as they are."""
    rows = staged(sequences(conversations), "turns")
    lengths = rows.groupBy(F.col("conv_id").alias("c")).agg(F.max("turns").alias("length"))
    return nodes(rows.select(F.col("conv_id").alias("c"), "pos", "digest", "n_bytes"), staged(lengths, "lengths"))


def report(conversations: DataFrame) -> DataFrame:
    """The query's columns, of the conversations rebuilt as its contract says."""
    return nodes(*rebuilt(staged(sequences(conversations), "turns"))).drop("name")

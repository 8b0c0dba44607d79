"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts become sets of 64-bit hashes of their distinct 5-word shingles. Documents of equal sets
   form a class; from here on a class is its smallest document.
2. A class's MinHash signature is cut into bands. In each bucket (band and values) every class is a
   candidate with the bucket's smallest class only, so a bucket of n classes gives n - 1 pairs.
3. Candidates are verified in sequence, each class with its smallest hub first and then with hubs that this has not
   joined it to: signatures are compared batch by batch, and a pair is dropped
   once the posterior probability that it is a link falls below the chosen miss probability.
   Survivors are verified on their full sets.
4. Links give components. Buckets that still hold several of them are open: their classes of different
   components may be linked too. Classes that can't be leave: a class shares at most the shingles that
   some other class of those buckets also holds, so a text edited in many places has no partner. Of the
   rest each holds out its rarest shingles, and only classes that share one of these are compared (prefix
   filter: two sets whose overlap is large enough share one of so many first elements in any common
   order). This loses no link and depends on rare shingles, not on buckets. Such pairs are pruned and
   verified alike; links among them join components.

So pairs within one component are never emitted, a group of copies costs a pair a member and band,
and no link among candidates is lost. Two texts at similarity 0.85 share no band with a probability of
(1 - 0.85^rows)^bands, 5.5e-11 with the defaults.

Hot groups: exact copies are joined by an aggregate with partial sums, a bucket's smallest class by
an aggregate too; joins on a bucket, a class or a shingle deal a hot one's rows to many tasks
(`common.spread`). Nothing is collected to the driver. Links and labels are cut with tables in the
shared folder. Defined results: null, empty and wordless texts have no shingles and stand alone;
repeated rows of an id count as one document, that of most shingles; rows of a null id are returned
each, without a component, and kept; texts under five words are one shingle; an empty table gives no
rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillon.llm.common import mix64, spread, staged, temporary


@dataclass(frozen=True)
class NearDup:
    width: int = 5
    #: Link at intersection x 100 >= percent x union.
    percent: int = 85
    bands: int = 32
    rows: int = 4
    #: Signature values compared at a time, and the probability at which a pair is given up.
    batch: int = 32
    miss: float = 1e-9
    #: How often the bound on shared shingles is drawn before classes of different components are paired.
    rounds: int = 2
    seed: int = 41


_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, A-Z lower-cased."""
    b = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.diff(np.concatenate([[False], ~_SPACE[b], [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, dtype=np.uint64)
    place = np.arange(len(b)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(b)]])))
    # each byte is mixed with its place in its word, so the sum over a word tells words apart
    mixed = mix64((b.astype(np.uint64) << _U(32)) + place.astype(np.uint64) + _BASE)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    return mix64(total[end] - total[begin] + (end - begin).astype(np.uint64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence as one if shorter."""
    w = word_hashes((text or "").encode())
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = mix64(h * _BASE + w[i : i + len(h)])
    return np.unique(h)


def _seeds(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _BASE + _U(seed)) | _U(1)


def signature(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Minima of the hashes under a multiplicative permutation for each seed, their upper half."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 1024):
        part = s[at : at + 1024]
        h = part[None, :] * seeds[:, None]
        h ^= h >> _U(29)
        h *= seeds[::-1, None]
        np.minimum(out, h.min(1), out=out)
    return (out >> _U(32)).astype(np.uint32)


def posterior_limits(setting: NearDup) -> list[tuple[int, int]]:
    """(values compared, least agreements): with fewer, P(similarity >= t) <= miss.

    With a uniform prior, similarity after m agreements of n is Beta(m + 1, n - m + 1); its upper tail
    at t equals the lower tail of a binomial of n + 1 draws.
    """
    t, n_all = setting.percent / 100, setting.bands * setting.rows
    limits = []
    for n in range(setting.batch, n_all + 1, setting.batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail > setting.miss:
                break
            m += 1
        limits.append((n, m))
    return limits


def prints(docs: DataFrame, setting: NearDup) -> DataFrame:
    """doc_id, n_shingles, and of non-empty sets a digest (key) and the signature, cut to 16 bits a value.

    Values cut short can only agree more often, so no link is lost by it.
    """
    width, n, seed = setting.width, setting.bands * setting.rows, setting.seed

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(n, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [shingles(x, width) for x in part.column(1).to_pylist()]
                key = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in found]
                signed = [signature(x, seeds).astype("<u2").tobytes() if len(x) else None for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(key, pa.binary()), pa.array(signed, pa.binary())],
                    names=["doc_id", "n_shingles", "key", "signature"],
                )

    return _texts(docs).mapInArrow(make, "doc_id long, n_shingles long, key binary, signature binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _sets(ids: DataFrame, docs: DataFrame, setting: NearDup) -> DataFrame:
    """(id, set) of the documents in ids; repeated rows of an id give the set of most shingles.

    Both sides grow with the corpus, so they are merged by id at every size.
    """
    width = setting.width

    @arrow_udf("binary")
    def make(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(x, width).astype("<u8").tobytes() for x in texts.to_pylist()], pa.binary())

    found = _texts(docs).hint("merge").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sized = found.select(F.col("doc_id").alias("id"), make("text").alias("set"))
    return sized.groupBy("id").agg(F.max_by("set", F.length("set")).alias("set"))


def _survive(a: Column, b: Column, setting: NearDup) -> Column:
    """Sequential test of two signatures."""
    limits = posterior_limits(setting)

    @arrow_udf("boolean")
    def test(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.bool_())
        n = limits[-1][0]
        same = np.frombuffer(b"".join(x.to_pylist()), dtype="<u2").reshape(-1, n) == np.frombuffer(b"".join(y.to_pylist()), dtype="<u2").reshape(-1, n)
        alive, at, agreed = np.arange(len(same)), 0, np.zeros(len(same), dtype=int)
        for upto, least in limits:  # only pairs still alive are compared on
            agreed[alive] += same[alive, at:upto].sum(1)
            alive, at = alive[agreed[alive] >= least], upto
        out = np.zeros(len(same), dtype=bool)
        out[alive] = True
        return pa.array(out)

    return test(a, b)


def _linked(a: Column, b: Column, setting: NearDup) -> Column:
    """Exact test of two sets."""
    percent = setting.percent

    @arrow_udf("boolean")
    def test(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            s, t = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (p, q))
            if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                out.append(False)
                continue
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * both >= percent * (len(s) + len(t) - both))
        return pa.array(out, pa.bool_())

    return test(a, b)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in links (a, b). Alternating star contraction."""
    told = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    edges, old = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        # large star: larger neighbours move to the smallest of the neighbourhood; a star's centre is a hot node
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread(both, low, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        new = staged(small.where("u <> v").distinct(), "edges")
        now = told(new)
        edges, before, old = new, old, now
        if before == now:
            return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")


def _verified(pairs: DataFrame, signed: DataFrame, content: DataFrame, setting: NearDup) -> DataFrame:
    """Those of pairs (a, b) that are links: signatures first, then survivors by their sets in content."""
    s = lambda side: signed.select(F.col("id").alias(side), F.col("signature").alias(f"s{side}"))
    of = lambda d: d.groupBy("b").agg(F.count(F.lit(1)).alias("rows"))  # noqa: E731  counted before the first join, which would run twice for it
    both = spread(spread(pairs, s("a"), "a", "b"), s("b"), "b", "a", sizes=of(pairs))
    alive = staged(both.where(_survive(F.col("sa"), F.col("sb"), setting)).select("a", "b"), "alive")
    c = lambda side: content.select(F.col("id").alias(side), F.col("set").alias(f"c{side}"))
    return spread(spread(alive, c("a"), "a", "b"), c("b"), "b", "a", sizes=of(alive)).where(_linked(F.col("ca"), F.col("cb"), setting)).select("a", "b")


def _apart(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """(a, b): hubs and classes of different components (id, component) of buckets (bucket, id, hub); most buckets hold one component and give none."""
    placed = staged(buckets.join(label, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c")), "placed")
    # a bucket's hub is its smallest class
    found = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.struct("id", "c")).alias("hub")).where("low <> high")
    both = spread(placed, found.select("bucket", "hub"), "bucket", "id").where(F.col("c") != F.col("hub")["c"])
    return both.select(F.col("hub")["id"].alias("a"), F.col("id").alias("b")).distinct()


def _held_by(ids: DataFrame, content: DataFrame) -> DataFrame:
    """(id, h): the shingles of the classes in ids."""

    @arrow_udf("array<long>")
    def unpack(sets: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x.as_buffer(), dtype="<i8") for x in sets], pa.list_(pa.int64()))

    return content.join(ids, "id", "left_semi").select("id", F.explode(unpack("set")).alias("h"))


def _own_shingles(ids: DataFrame, content: DataFrame) -> DataFrame:
    """(id, own): how many shingles of a class no other class of ids holds; classes with none are left out."""
    # partial minima and maxima: a shingle that every class holds is a row a task
    single = _held_by(ids, content).groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    return single.groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def _several(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with the smallest size there if sizes are known."""
    least = [F.min("n").alias("least")] if "n" in rows.columns else []
    found = rows.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), *least).where("low <> high").drop("low", "high")
    return spread(rows, found, "bucket", "id")


def _open_pairs(buckets: DataFrame, label: DataFrame, classes: DataFrame, content: DataFrame, setting: NearDup) -> DataFrame:
    """Pairs (a, b) of classes of different components in open buckets that may be linked, each pair once.

    A link of sizes n and m needs percent / (100 + percent) x (n + m) shared shingles, and sizes whose ratio is
    percent at least; both are tested on bounds that hold for every pair, so none that is linked is left out.
    """
    percent = F.lit(setting.percent)
    placed = staged(buckets.join(label, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c")), "placed")
    able = staged(_several(placed), "apart")
    if able.isEmpty():  # no bucket is open
        return able.sparkSession.createDataFrame([], "a long, b long")
    for _ in range(setting.rounds):  # shingles that only classes found unable hold count no more
        own = _own_shingles(able.select("id").distinct(), content)
        shared = (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared")
        sized = staged(able.select("bucket", "id", "c").join(classes.join(own, "id", "left").select("id", "n", shared), "id"), "sized")
        smallest = F.greatest(F.col("least") * 100, F.col("n") * percent)  # a partner's size, times 100
        able = staged(_several(sized).where(100 * (100 + percent) * F.col("shared") >= percent * (100 * F.col("n") + smallest)).drop("least"), "able")

    ids = staged(able.select("id", "c", "n", "shared").distinct(), "open")
    first = staged(_rarest(ids, content, setting), "rarest")
    # of two classes the smaller is looked up by fewer shingles: its overlap must be larger against its size
    side = lambda s, least: first.where(F.col("rank") <= F.col("n") - F.ceil(least * F.col("n")) + 1).select(
        "h", *[F.col(x).alias(f"{x}_{s}") for x in ("id", "c", "n", "shared", "rank")]
    )
    share = setting.percent / 100
    small, large = side("a", 2 * share / (1 + share) - 1e-9), side("b", share - 1e-9)
    n, m = F.col("n_a"), F.col("n_b")
    fits = (100 * n >= percent * m) & ((100 + percent) * F.least("shared_a", "shared_b") >= percent * (n + m))
    # of the first shingle that two sets share in the common order, no more can be shared than what comes after it in either
    left = F.least(n - F.col("rank_a"), m - F.col("rank_b")) + 1
    fits = fits & ((100 + percent) * left >= percent * (n + m))
    ordered = F.struct("n_a", "id_a") < F.struct("n_b", "id_b")
    pairs = spread(large, small, "h", "id_b", ordered & (F.col("c_a") != F.col("c_b")) & fits)
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _rarest(ids: DataFrame, content: DataFrame, setting: NearDup) -> DataFrame:
    """(id, c, n, shared, h, rank): the shingles that two classes of ids share, by how few hold them, as far as a link can need.

    rank counts the shingles that no other class holds as the first ones.
    """
    held_by = staged(_held_by(ids, content), "held")
    held = held_by.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    rows = spread(held_by, held, "h", "id").join(ids, "id")
    of_id = Window.partitionBy("id")
    rank = F.row_number().over(of_id.orderBy("f", "h")) + F.col("n") - F.count(F.lit(1)).over(of_id)
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil((setting.percent / 100 - 1e-9) * F.col("n")) + 1)
    return rows.select("id", "c", "n", "shared", "h", "rank")


def groups(docs: DataFrame, setting: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per doc_id of docs."""
    known = docs.where(docs["doc_id"].isNotNull())
    every = prints(known, setting).groupBy("doc_id").agg(F.max_by(F.struct("n_shingles", "key", "signature"), F.struct("n_shingles", "key")).alias("x"))
    every = staged(every.select("doc_id", "x.*"), "prints")
    # equal sets: the class's smallest id; they have equal signatures
    reps = every.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    reps = staged(reps, "classes")

    width = 2 * setting.rows
    band = F.explode(F.sequence(F.lit(0), F.lit(setting.bands - 1))).alias("band")
    bucket = F.xxhash64("band", F.substring("signature", F.col("band") * width + 1, F.lit(width)))
    banded = reps.select("id", "signature", band).select("id", bucket.alias("bucket"))
    shared = staged(banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "hubs")
    buckets = staged(spread(banded, shared.drop("rows"), "bucket", "id", sizes=shared.select("bucket", "rows")), "buckets")  # only buckets of several classes
    signed = reps.select("id", "signature")
    content = staged(_sets(buckets.select("id").distinct(), known, setting), "sets")  # texts are shuffled this once

    tested = staged(buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    # each class with its smallest hub first: of a group's other pairs only those are left that its links don't connect
    first = staged(tested.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    label = staged(components(staged(_verified(first, signed, content, setting), "links")), "labels")
    apart = staged(_apart(buckets, label).join(first, ["a", "b"], "left_anti"), "pairs")
    links = staged(_verified(apart, signed, content, setting), "links")
    if not links.isEmpty():
        label = staged(components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(links)), "labels")
    # what buckets still hold apart: classes of different components that were not compared yet
    open_pairs = _open_pairs(buckets, label, reps.select("id", "n"), content, setting).join(tested, ["a", "b"], "left_anti")
    new = staged(_verified(staged(open_pairs, "pairs"), signed, content, setting), "links")
    if not new.isEmpty():  # the components so far are stars already, so few rounds are left
        label = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(new))
    of_key = reps.select("key", "id").join(label, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    linked = spread(every.where("key is not null").select("doc_id", "n_shingles", "key"), of_key, "key", "doc_id").select("doc_id", "n_shingles", "component")
    alone = every.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    d = linked.unionAll(alone).select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
    nameless = prints(docs.where(docs["doc_id"].isNull()), setting)
    return d.unionAll(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long"), F.lit(True)))


def keep_first(docs: DataFrame, setting: NearDup = NearDup()) -> DataFrame:
    """docs with one document of each component: its smallest id (rows of a null id are kept)."""
    name = temporary(docs, "drop")
    drop = groups(docs, setting).where("not kept").select(F.col("doc_id").alias(name))
    return docs.join(drop, docs["doc_id"].cast("long") == F.col(name), "left_anti")

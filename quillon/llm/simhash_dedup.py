"""SimHash near-duplicates, found by deletion variants of few segments.

1. A text's fingerprint has a bit for each bit position that over half the XXH64 values of its 3-word shingles have.
   Equal fingerprints are one class; from here on a class is its fingerprint.
2. Two fingerprints at three differing bits or fewer, cut into two segments, differ by one bit at most in one of them.
   Each class is indexed under every segment with one bit left out (2 x 32 variants): an equality join finds every such
   pair, and the bits of both decide. Plain blocks for equality alone would need four segments of half the length.
3. Buckets of two classes are judged by their smallest and largest class, which the count brings along. Larger buckets are
   gathered up to `SimHash.bucket` classes and give a spanning forest of their links, at most a row a class, not all pairs.
4. A bucket of more classes is cut by the same rule again: its classes agree on one segment but for a bit, so the other
   one is cut into two halves, of which one differs by a bit at most, and once more into quarters. What is then left open
   is 11 bits, so a bucket of the last kind holds 2,048 classes at most, whatever the input.
5. Components of the links, by star contraction; a component's smallest doc_id is looked up once.

So no link is lost, and copies are never expanded into pairs. Hot groups: exact copies are joined by an aggregate with
partial sums; joins on a bucket, a component or a fingerprint deal a hot one's rows to many tasks (`common.spread`).
Nothing grows on the driver. Tables in the shared folder cut lineage.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other; texts under three words are
one shingle; texts of any length are read whole. Repeated rows of an id count as one document, that of most shingles (of
these the greatest fingerprint). Rows of a null id are returned each, with a fingerprint, without a component, and link
nothing. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import spread, staged
from quillon.llm.near_dedup import components


@dataclass(frozen=True)
class SimHash:
    width: int = 3
    seed: int = 42
    #: Classes of a bucket that are compared in one place; larger buckets are cut (but for the last cut, which bounds them).
    bucket: int = 256


#: Differing bits of a link. The cuts into two segments hold for 2 and 3.
DISTANCE = 3


def fingerprint(raw: bytes, setting: SimHash) -> tuple[int, int]:
    """(number of shingles, fingerprint as a signed 64-bit number) of a text in UTF-8."""
    words = raw.lower().split()  # A-Z only, and the six bytes of the word definition
    if not words:
        return 0, 0
    text, k = b" ".join(words), min(setting.width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    begin = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1].tolist()
    digest, seed = xxhash.xxh64_intdigest, setting.seed
    h = np.fromiter((digest(text[a:b], seed) for a, b in zip(begin, (ends[k - 1 :] - 1).tolist(), strict=True)), dtype="<u8", count=len(begin))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return len(h), int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, setting: SimHash = SimHash()) -> DataFrame:
    """doc_id, n_shingles and fp for each row of docs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or b"", setting) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], [])))], names=["doc_id", "n_shingles", "fp"])

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return d.mapInArrow(make, "doc_id long, n_shingles long, fp long")


def forest(x: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever the links among the fingerprints x connect."""
    near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= DISTANCE
    new, links = np.ones(len(x), dtype=bool), []
    for root in range(len(x)):
        if new[root]:
            new[root] = False
            reached = [root]
            while reached:
                i = reached.pop()
                found = np.flatnonzero(near[i] & new)
                new[found] = False
                links += [(int(x[i]), int(x[j])) for j in found]
                reached += found.tolist()
    return links


def _forests(buckets: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links of each bucket (key, fp); a bucket's classes meet in one place."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [y for x in batch.column(0) for y in forest(x.values.to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*links, strict=True) if links else ([], []))], names=["a", "b"])

    gathered = buckets.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return gathered.select("fps").mapInArrow(link, "a long, b long")


#: Segments with one bit left out. Level 1 cuts the fingerprint into two of 32 bits (variant v), level 2 the other segment
#: into two of 16 (u), level 3 the other half of that into two of 8 (t). A key names the variants and the bits that are left.
_CUTS = (
    ("sequence(0, 63) AS v", "fp", "shiftleft(CAST(v AS BIGINT), 32) | (shiftrightunsigned(fp, 32 * (v DIV 32)) & 4294967295L & ~shiftleft(1L, v % 32))"),
    ("sequence(0, 31) AS u", "shiftrightunsigned(fp, CAST(32 * (1 - shiftright(key, 37)) AS INT)) & 4294967295L", "shiftleft(key, 21) | shiftleft(CAST(u AS BIGINT), 16) | (shiftrightunsigned(rest, 16 * (u DIV 16)) & 65535L & ~shiftleft(1L, u % 16))"),
    ("sequence(0, 15) AS t", "shiftrightunsigned(shiftrightunsigned(fp, CAST(32 * (1 - shiftright(key, 58)) AS INT)) & 4294967295L, CAST(16 * (1 - (shiftright(key, 20) & 1)) AS INT)) & 65535L", "xxhash64(key, t, shiftrightunsigned(rest, 8 * (t DIV 8)) & 255L & ~shiftleft(1L, t % 8))"),
)


def _variants(rows: DataFrame, level: int) -> DataFrame:
    """(key, fp) for each variant of the given cut; rows hold fp and, but for the first cut, the key of the bucket that is cut."""
    sequence, rest, key = _CUTS[level]
    numbers, name = sequence.split(" AS ")
    return rows.selectExpr("*", f"explode({numbers}) AS {name}").selectExpr("*", f"{rest} AS rest").selectExpr(f"{key} AS key", "fp")


def _links(variants: DataFrame, level: int, setting: SimHash) -> DataFrame:
    """(a, b): links that connect what the links within buckets (key, fp) connect."""
    if level == len(_CUTS) - 1:
        return _forests(variants)
    sizes = variants.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("rows > 1")
    sizes = staged(sizes, "sizes")
    two = sizes.where(F.col("rows") == 2).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    many = sizes.where("rows > 2").select("key", "rows")
    if many.isEmpty():
        return two
    rows = staged(spread(variants, many.withColumnRenamed("rows", "n"), "key", "fp", sizes=many, merge=True), "buckets")
    links = two.unionAll(_forests(rows.where(F.col("n") <= setting.bucket).select("key", "fp")))
    large = rows.where(F.col("n") > setting.bucket).select("key", "fp")
    return links if large.isEmpty() else links.unionAll(_links(_variants(large, level + 1), level + 1, setting))


def groups(docs: DataFrame, setting: SimHash = SimHash()) -> DataFrame:
    """doc_id, n_shingles, fp, component_id: one row per doc_id of docs, and each row of a null id."""
    rows = staged(fingerprints(docs, setting), "fingerprints")
    every = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "fp")).alias("x")).select("doc_id", "x.*")
    classes = staged(every.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    links = staged(_links(_variants(classes.select("fp"), 0), 0, setting).distinct(), "links")
    label = components(links).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    rooted = staged(classes.join(label, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = spread(rooted.select("fp", "root"), smallest, "root", "fp").select("fp", "component_id")
    found = spread(every, of_class, "fp", "doc_id").select("doc_id", "n_shingles", "fp", "component_id")
    return found.unionAll(rows.where("doc_id IS NULL").select("doc_id", "n_shingles", "fp", F.lit(None).cast("long")))


def report(docs: DataFrame) -> DataFrame:
    """The query's columns, and n_shingles."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_shingles")

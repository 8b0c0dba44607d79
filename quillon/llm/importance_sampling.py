"""Quality classifier by importance resampling.

Two generative models of hashed word unigrams and bigrams are counted: one of target text (the
labelled documents of good quality), one of all raw text. A document's weight is the ratio of the
two models: the sum of its n-grams' log ratios; adding Gumbel noise, drawn from a hash of its doc_id, and taking the
k largest draws k documents without replacement with probability in proportion to their weight.

Counting is a sum of fixed-length vectors, one a task; the models have a fixed size. The k-th largest
key is found by radix selection over counts, so nothing is sorted or collected whatever k is. Defined
results: a null or empty text has log ratio 0; rows of a null id share their noise; ties at the threshold are drawn by the hash of doc_id
and are all kept if that too is equal (repeated rows); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14


@dataclass(frozen=True)
class Resampling:
    buckets: int = BUCKETS
    #: Added to each bucket's count.
    prior: float = 1.0
    #: Scale of the Gumbel noise against the summed log ratio; 1 is exact importance resampling.
    temperature: float = 1.0
    #: N-grams a document that count toward the sum: beyond so many it is the mean times this. Without bound it is the models' log ratio itself.
    sharpness: float = math.inf
    seed: int = 17


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def ngram_buckets(text: str, buckets: int) -> np.ndarray:
    """Bucket of each unigram and bigram of the lower-cased words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=True)
    two = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate([_mix(h), two]) % np.uint64(buckets)).astype(np.int64)


def count_models(docs: DataFrame, labels: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of the target documents (quality 1 in labels) and of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros(2 * buckets, dtype=np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.bincount(ngram_buckets(text or "", buckets), minlength=buckets)
                both[buckets:] += got
                if target:
                    both[:buckets] += got
        full = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(both[full])], names=["bucket", "n"])

    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # both sides grow with the input: merged at every size
    d = d.hint("merge").join(good, F.col("doc_id") == F.col("id"), "left").select("text", F.col("id").isNotNull().alias("target"))
    rows = d.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(2 * buckets, dtype=np.int64)  # 2 x buckets rows at most, whatever the corpus
    for row in rows:
        both[row["bucket"]] = row["n"]
    return both[:buckets], both[buckets:]


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float) -> np.ndarray:
    p = (target + prior) / (target.sum() + prior * len(target))
    q = (raw + prior) / (raw.sum() + prior * len(raw))
    return np.log(p) - np.log(q)


def scored(docs: DataFrame, ratio: np.ndarray, setting: Resampling) -> DataFrame:
    """doc_id, log_weight, n_ngrams for each row."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    buckets, sharpness = setting.buckets, setting.sharpness

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = held.value
        for batch in batches:
            found = [ratios[ngram_buckets(x or "", buckets)] for x in batch.column(1).to_pylist()]
            n = [len(x) for x in found]
            w = [float(x.mean()) * min(len(x), sharpness) if len(x) else 0.0 for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "log_weight", "n_ngrams"])

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return d.mapInArrow(score, "doc_id long, log_weight double, n_ngrams long")


def top_k(rows: DataFrame, key: str, k: int, bits: int = 12) -> DataFrame:
    """Adds kept: whether the row's long key is among the k largest (with all that equal the last of them).

    Radix selection: each round counts the digit after the prefix found so far, so a round's result
    has 2^bits rows at most.
    """
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    # the sign bit is flipped, so that unsigned digits order as signed longs do
    flipped = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
    prefix, need, shift = 0, k, 64
    while shift > 0:
        width = min(bits, shift)
        low = shift - width
        here = rows if shift == 64 else rows.where(F.call_function("shiftrightunsigned", flipped, F.lit(shift)) == F.lit(prefix))
        digit = F.call_function("shiftrightunsigned", flipped, F.lit(low)).bitwiseAND(F.lit((1 << width) - 1))
        counts = {r["d"]: r["count"] for r in here.groupBy(digit.alias("d")).count().collect()}
        for d in sorted(counts, reverse=True):
            if need <= counts[d]:
                prefix, shift = (prefix << width) | d, low
                break
            need -= counts[d]
        else:
            return rows.withColumn("kept", F.lit(True))  # no more than k rows
    least = prefix - (1 << 63)
    return rows.withColumn("kept", F.col(key) >= F.lit(least))


def gumbel_key(log_weight, doc_id, setting: Resampling):
    """The perturbed weight as a long that orders the same way, to a thousandth of 2^-20."""
    u = (F.call_function("shiftrightunsigned", F.xxhash64(doc_id, F.lit(setting.seed)), F.lit(11)).cast("double") + 0.5) / F.lit(float(1 << 53))
    noise = -F.log(-F.log(u))
    return F.round((log_weight / setting.temperature + noise) * (1 << 30)).cast("long")


def resample(docs: DataFrame, labels: DataFrame, share: float, setting: Resampling = Resampling()) -> DataFrame:
    """doc_id, log_weight, n_ngrams, key and kept: round(share x rows) documents drawn by Gumbel top-k."""
    from quillon.llm.common import staged

    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    target, raw = count_models(docs, labels, setting.buckets)
    ratio = log_ratio(target, raw, setting.prior)
    rows = scored(docs, ratio, setting).withColumn("key", gumbel_key(F.col("log_weight"), F.col("doc_id"), setting))
    rows = staged(rows, "importance")  # few bytes a document; counted several times
    k = math.floor(share * rows.count() + 0.5)
    return top_k(rows, "key", k)

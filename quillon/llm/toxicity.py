"""Toxicity by weak supervision.

1. Lexicon entries (whole words, word beginnings, and beginnings that several distinct words of a text share)
   are mined from a bounded sample of labelled training rows, and a few seed words and patterns are added. Of the
   very many candidates some go with toxic rows by chance: entries are taken as far as the share of chance entries
   among them is expected to be `chance` at most (Benjamini and Hochberg's rule on a bound of the binomial tail).
2. Entries are dealt to voters by their make, as words, beginnings and repeated beginnings tell differently
   much; each votes "toxic" where one of its entries occurs. How often each pattern of votes occurs is counted over
   all documents (2^voters patterns at most).
3. A generative label model is fitted to these counts by expectation maximisation: each voter's
   rates among toxic and clean documents, the share of toxic ones, and correlations: voters that
   agree beyond what the label explains share their weight.
4. A logistic regression on the entries learns the posterior labels of a bounded sample of documents.

Held-out rows never lend their labels. lang, source and doc_id are no inputs of a score. Scoring is
one pass over the texts with a model of fixed size, or over the entries that the votes found: no shuffle. Defined results: null and empty
texts score as a document without entries; repeated rows score alike; rows of a null id are scored and
not held out; a doc_id labelled both ways counts as toxic; an empty table gives no rows; texts of any
length are read whole; labels without a document, null labels and extra columns are ignored; without any toxic training label the seeds stand alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillon.llm.common import staged, temporary

# Seed entries that vote wherever they occur as words.
SEEDS = (
    "idiot", "idiots", "moron", "scum", "stupid", "pathetic", "worthless", "disgusting", "loser", "bastard", "imbecile",
    "dumbass", "vermin", "subhuman", "dummkopf", "abschaum", "arschloch", "crétin", "salaud", "connard", "estúpido",
    "imbécil", "escoria", "gilipollas",
)
# Abusive phrasings.
PATTERNS = (
    r"\byou(?:'re| are) (?:an? )?(?:\w+ )?(?:idiot|moron|loser|trash|scum|clown)",
    r"\b(?:shut up|drop dead|go to hell|i hate you)\b",
    r"\b(?:du bist ein|tu es un|eres un) (?:idiot|crétin|imbécil)",
)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    #: Bounds of the sample of labelled rows from which entries are mined.
    toxic_rows: int = 2000
    clean_rows: int = 4000
    #: At most so many mined entries; least documents and least log odds ratio of an entry.
    entries: int = 160
    least_rows: int = 3
    least_log_odds: float = 3.0
    #: Expected share of entries that are there by chance.
    chance: float = 0.1
    #: Lengths of word beginnings, and how many distinct words share one.
    beginnings: tuple[int, ...] = (4, 5, 6, 7)
    repeats: tuple[int, ...] = (1, 2, 3, 4)
    #: Eight at least.
    voters: int = 12
    #: Bound of the sample that the classifier learns from.
    classifier_rows: int = 20_000
    rounds: int = 60
    ridge: float = 0.3
    threshold: float = 0.7


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def grams(text: str, beginnings: tuple[int, ...], repeats: tuple[int, ...]) -> set[str]:
    """Distinct lower-cased words (`=word`) and beginnings that so many of them share (`begin-1`, `begin-2`, ...)."""
    words = set(_WORD.findall(text.lower()))
    found = {f"={w}" for w in words}
    for n in beginnings:
        shared = Counter(w[:n] for w in words if len(w) > n)
        found.update(f"{b}-{m}" for b, k in shared.items() for m in repeats if k >= m)
    return found


def _training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the rows to learn from; a doc_id that is labelled both ways counts as toxic."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def mine(docs: DataFrame, labels: DataFrame, setting: Settings) -> list[str]:
    """Entries that set toxic training rows apart, most telling first."""
    known = _training_labels(labels)
    order = F.xxhash64("doc_id", F.lit(5))
    part = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(n).select("doc_id", "toxic")
    chosen = part(1, setting.toxic_rows).unionAll(part(0, setting.clean_rows))
    of = {r["doc_id"]: int(r["toxic"]) for r in chosen.collect()}  # toxic_rows + clean_rows at most
    if not of:
        return []
    ids = docs.sparkSession.createDataFrame(list(of.items()), "doc_id long, toxic int")
    beginnings, repeats = setting.beginnings, setting.repeats

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(grams(text or "", beginnings, repeats))
                rows[toxic] += 1
        keys = ["", *{*seen[0], *seen[1]}]
        seen[0][""], seen[1][""] = rows
        cols = [pa.array(keys), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["gram", "toxic", "clean"])

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    d = d.join(F.broadcast(ids), "doc_id").select("text", "toxic")
    counts = d.mapInArrow(count, "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = staged(counts, "grams")
    total = {r["gram"]: (r["t"], r["c"]) for r in counts.where("gram = ''").collect()}.get("", (0, 0))
    tried = counts.count() - 1
    if not total[0]:
        return []
    odds = F.log((F.col("t") + 0.5) / (total[0] + 1.0)) - F.log((F.col("c") + 0.5) / (total[1] + 1.0))
    base, n = total[0] / (total[0] + total[1] + 1.0), F.col("t") + F.col("c")
    # log of a bound on the probability of so many toxic rows among those that hold the entry, if it told nothing
    tail = -F.col("t") * F.log(F.col("t") / n / base) - F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / n / (1 - base))).otherwise(0.0)
    best = (
        counts.where((F.col("gram") != "") & (F.col("t") >= setting.least_rows)).where(odds >= setting.least_log_odds)
        .select("gram", tail.alias("tail")).orderBy("tail", "gram").limit(setting.entries).collect()
    )
    sure = [i + 1 for i, r in enumerate(best) if r["tail"] <= math.log(setting.chance * (i + 1) / tried)]
    return [r["gram"] for r in best[: max(sure, default=0)]]


@dataclass
class Model:
    entries: list[str]
    weights: np.ndarray
    bias: float
    voter_of: np.ndarray
    #: Of each voter: its firing rate among toxic and clean documents, and the power it votes with.
    rates: np.ndarray = field(default_factory=lambda: np.empty((0, 3)))
    share: float = 0.1


class Matcher:
    """The places of the entries that a text holds."""

    def __init__(self, entries: list[str]):
        self.place = {x: i for i, x in enumerate(entries)}
        self.words = {x[1:]: i for x, i in self.place.items() if x[0] == "="}
        self.patterns = [(i, re.compile(x[1:])) for x, i in self.place.items() if x[0] == "~"]
        #: By length: beginning -> (words that must share it, place).
        self.begin: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for x, i in self.place.items():
            if x[0] not in "=~":
                start, _, least = x.rpartition("-")
                self.begin.setdefault(len(start), {}).setdefault(start, []).append((int(least), i))
        self.least = min(self.begin, default=0)
        self.first = {b[: self.least] for known in self.begin.values() for b in known}

    def __call__(self, text: str | None) -> list[int]:
        low = (text or "").lower()
        words = set(_WORD.findall(low))
        found = {self.words[w] for w in self.words.keys() & words}
        some = [w for w in words if w[: self.least] in self.first] if self.begin else []
        for n, known in self.begin.items():
            for start, k in Counter(w[:n] for w in some if len(w) > n and w[:n] in known).items():
                found.update(i for least, i in known[start] if k >= least)
        found.update(i for i, pattern in self.patterns if pattern.search(low))
        return sorted(found)


def deal(entries: list[str], voters: int) -> np.ndarray:
    """The voter of each entry: by its make, and there by a hash of the word's beginning, so that forms of a word vote as one."""

    def voter(x: str) -> int:
        if x[0] == "~":
            return voters - 1
        stem, _, least = x.lstrip("=").partition("-")
        first, many = (0, voters - 7) if x[0] == "=" else (voters - 7 + 2 * (min(int(least), 3) - 1), 2)
        return first + zlib.crc32(stem[:4].encode()) % many

    return np.array([voter(x) for x in entries], dtype=int)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """EM over distinct vote patterns (rows of 0 and 1).

    counts has a row per pattern: documents without a label to learn from, labelled clean, labelled
    toxic; the labelled keep their labels and give the share of toxic ones. A voter that is silent
    abstains; that all are silent counts as one more vote. Gives (rate if toxic, rate if clean,
    power) by voter, the last row for silence, and the share.
    """
    silent = patterns.sum(1, keepdims=True) == 0
    patterns = np.hstack([patterns, silent])
    m = patterns.shape[1]
    power = np.ones(m)
    share = (counts[:, 2].sum() + 1) / (counts[:, 1:].sum() + 10)
    post = np.where(silent[:, 0], 0.01, 0.9)
    for outer in range(3):
        for _ in range(rounds):
            toxic, clean = counts[:, 0] * post + counts[:, 2], counts[:, 0] * (1 - post) + counts[:, 1]
            a = (toxic @ patterns + 0.1) / (toxic.sum() + 1)
            b = (clean @ patterns + 0.1) / (clean.sum() + 10)
            b[:-1] = np.minimum(b[:-1], a[:-1] / 2)  # better than chance, by construction
            post = posterior(patterns, np.stack([a, b, power], 1), share)
        if outer < 2:  # what voters share beyond the label, within each class
            extra = np.zeros((m, m))
            for weight, rate in ((toxic, a), (clean, b)):
                z = (patterns - rate) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
                if weight.sum() > 50:
                    extra = np.maximum(extra, np.clip((z * weight[:, None]).T @ z / weight.sum(), 0, 1))
            np.fill_diagonal(extra, 0)
            extra[-1], extra[:, -1] = 0, 0
            extra[extra < 0.2] = 0
            power = 1 / (1 + extra.sum(1))
    return np.stack([a, b, power], 1), share


def posterior(votes: np.ndarray, rates: np.ndarray, share: float) -> np.ndarray:
    if votes.shape[1] < len(rates):
        votes = np.hstack([votes, votes.sum(1, keepdims=True) == 0])
    a, b, power = rates.T
    ll = math.log(share / (1 - share)) + votes @ (power * np.log(a / b))
    return 1 / (1 + np.exp(-np.clip(ll, -50, 50)))


def fit_classifier(rows: list[list[int]], target: np.ndarray, n: int, rounds: int = 300, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of entries with soft labels, by Newton's method on distinct rows."""
    merged: dict[tuple[int, ...], list[float]] = {}
    for row, y in zip(rows, target, strict=True):
        cell = merged.setdefault(tuple(row), [0.0, 0.0])
        cell[0] += 1
        cell[1] += y
    x = np.zeros((len(merged), n + 1))
    for i, row in enumerate(merged):
        x[i, list(row)] = 1
    x[:, n] = 1
    count, hit = np.array(list(merged.values())).reshape(-1, 2).T
    w = np.zeros(n + 1)
    penalty = np.full(n + 1, ridge)
    penalty[n] = 1e-3
    for _ in range(min(rounds, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (hit - count * p) - penalty * w
        hessian = (x * (count * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, setting: Settings = Settings()) -> Model:
    return _fit(docs, labels, setting)[0]


def fitted_scores(docs: DataFrame, labels: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """`scores` of docs by the model that `fit` makes of them, from the entries that its votes have found: texts are read once."""
    model, seen = _fit(docs, labels, setting)
    weights = F.array(*[F.lit(float(x)) for x in model.weights])
    z = F.aggregate("found", F.lit(model.bias), lambda a, i: a + F.get(weights, i))
    return _shown(seen.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))).alias("score")), setting.threshold)


def _fit(docs: DataFrame, labels: DataFrame, setting: Settings) -> tuple[Model, DataFrame]:
    """The model, and (doc_id, found, bits) of each row: the places of the entries it holds, and its votes."""
    mined = mine(docs, labels, setting)
    entries = list(dict.fromkeys([*mined, *(f"={x}" for x in SEEDS), *(f"~{x}" for x in PATTERNS)]))
    voter_of = deal(entries, setting.voters)
    voters = setting.voters

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(entries)
        for batch in batches:
            found = [match(x) for x in batch.column(0).to_pylist()]
            bits = [int(sum(1 << int(v) for v in {voter_of[i] for i in x})) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(bits, pa.int64())], names=["doc_id", "found", "bits"])

    d = docs.select(docs["text"].cast("string").alias("text"), docs["doc_id"].cast("long").alias("doc_id"))
    seen = staged(d.mapInArrow(votes, "doc_id long, found array<int>, bits long"), "votes")  # a few bytes a document
    voted = seen.select("doc_id", "bits").join(_training_labels(labels), "doc_id", "left")
    tally = voted.groupBy("bits").pivot("toxic", [0, 1]).count().join(seen.groupBy("bits").count(), "bits").na.fill(0).collect()  # 2^voters rows at most
    if not tally:
        return Model(entries, np.full(len(entries), 6.0), -3.0, voter_of), seen
    bits = np.array([r["bits"] for r in tally])
    patterns = ((bits[:, None] >> np.arange(voters)) & 1).astype(float)
    counts = np.array([[r["count"] - r["0"] - r["1"], r["0"], r["1"]] for r in tally], dtype=float)
    rates, share = fit_label_model(patterns, counts, setting.rounds)
    sample = seen.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "bits").limit(setting.classifier_rows).collect()
    soft = posterior(np.array([[r["bits"] >> v & 1 for v in range(voters)] for r in sample], dtype=float), rates, share)
    weights, bias = fit_classifier([r["found"] for r in sample], soft, len(entries), ridge=setting.ridge)
    return Model(entries, weights, bias, voter_of, rates, share), seen


def score_column(docs: DataFrame, model: Model) -> Column:
    """The score of docs' text, 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        match = Matcher(m.entries)
        for texts in parts:
            z = [m.bias + float(m.weights[match(x)].sum()) for x in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -50, 50))), dtype="float64")

    return score(docs["text"].cast("string"))


def scores(docs: DataFrame, model: Model, threshold: float = Settings.threshold) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    return _shown(docs.select("doc_id", score_column(docs, model).alias("score")), threshold)


def _shown(d: DataFrame, threshold: float) -> DataFrame:
    return d.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = Settings.threshold) -> DataFrame:
    """docs without rows that the model rejects."""
    name = temporary(docs, "score")
    return docs.withColumn(name, score_column(docs, model)).where(F.col(name) < threshold).select(docs.columns)

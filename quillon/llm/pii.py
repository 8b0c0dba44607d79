"""Personal data: candidate generators and gradient-boosted trees, on DataFrame functions only.

Base kinds (email, ip, card, phone) are found by their expressions and tests and always stay. Other
generators propose spans with high recall (keys, hexadecimal tokens, assigned passwords, national
numbers, account numbers, local phone numbers). Each runs by itself, so proposals overlap one another
and base spans. Boosted trees score each proposal by format and context, and a threshold for each kind,
calibrated on rows that the trees have not seen, selects what is added. Trees and thresholds become
one SQL expression.

The trees are trained on the driver on a synthetic, seeded set of TRAINING_ROWS proposals, whose
features come from the same expressions. All else happens within the row: no shuffle, no state, and
time in proportion to the text and its spans, whatever their number. Defined results: a null text is
empty and has no spans; repeated rows and rows of a null id are scanned one by one; equal spans of
different kinds are all given; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bound, held, temporary, text_of

# The base expressions. Possessive forms and looks behind match the same spans as the
# plain ones, but need time in proportion to the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

# Further generators. Lengths are open: a long secret is proposed whole.
KEY_HEADS = ("AKIA", "ASIA", "AROA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-")
GENERATORS = {
    "key": rf"(?<![A-Za-z0-9])(?:{'|'.join(KEY_HEADS)})[A-Za-z0-9_-]{{12,}}+",
    "password": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api_?key|auth)(?:_[A-Za-z_]*+|[A-Z][A-Za-z_]*+|s)?+[\x20]?[=:][\x20]?[^\s,;]{4,}+",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{16,}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "local": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
ORDER = {k: i for i, k in enumerate((*KINDS, *GENERATORS))}
TRAINING_ROWS = 3000
#: Characters before a proposal that count as its context.
CONTEXT = 24
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,s:string>>"
PROPOSAL = "array<struct<start:int,rank:int,end:int,kind:string,s:string,before:string>>"
#: Elements of a running sum, and characters of a long text, that are handled as one block.
_BLOCK, _CHUNK = 256, 1024


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether a string's digits pass the Luhn test."""
    d = F.reverse(_digits(s))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.ascii(F.substr(d, i, F.lit(1))) - 48).otherwise(
            (F.ascii(F.substr(d, i, F.lit(1))) - 48) * 2 - F.when(F.substr(d, i, F.lit(1)) > "4", F.lit(9)).otherwise(F.lit(0))
        ),
    )
    return total % 10 == 0


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of values (longs) what combine makes of 0 and all before it, and one more for all of them.

    Blocks of values are folded first, then each block starts from the fold of those before it, so an
    array grows by single elements only within a block, and the time is in proportion to the values.
    """
    zero = F.lit(0).cast("long")
    last = lambda x: F.element_at(x, -1)
    grown = lambda x, v: F.concat(x, F.array(combine(last(x), v)))

    def made(blocks: Column) -> Column:
        heads = F.aggregate(blocks, F.array(zero), lambda x, b: F.concat(x, F.array(F.aggregate(b, last(x), combine))))
        return bound(
            F.struct(blocks.alias("b"), heads.alias("h")),
            lambda x: F.concat(
                F.flatten(F.transform(x["b"], lambda b, k: F.slice(F.aggregate(b, F.array(F.get(x["h"], k)), grown), 1, F.size(b)))), F.array(last(x["h"]))
            ),
        )

    count = F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int")
    cut = bound(values, lambda v: F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(v, k * _BLOCK + 1, _BLOCK)))
    return F.when(F.size(values) > 0, bound(cut, made)).otherwise(F.array(zero))


def _located(text: Column, pattern: str) -> Column:
    """Matches of pattern as an array of (start, s, before): leftmost, not overlapping; code points.

    What lies between matches (split) and the matches themselves alternate, so lengths give places.
    before: the last characters between this match and the one before it.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = bound(
        F.struct(between.alias("b"), found.alias("m")),
        lambda x: F.zip_with(F.slice(x["b"], 1, F.size(x["m"])), x["m"], lambda b, m: F.struct(F.length(b).alias("n"), F.right(b, F.lit(CONTEXT)).alias("before"), m.alias("s"))),
    )

    def placed(p: Column) -> Column:
        at = _running(F.transform(p, lambda x: (x["n"] + F.length(x["s"])).cast("long")), lambda a, v: a + v)
        return F.zip_with(p, F.slice(at, 1, F.size(p)), lambda x, a: F.struct((a + x["n"]).cast("int").alias("start"), x["s"].alias("s"), x["before"].alias("before")))

    return bound(pairs, placed)


def _spans(found: Column, kind: str, *also: str) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(ORDER[kind]).alias("rank"), (x["start"] + F.length(x["s"])).alias("end"), F.lit(kind).alias("kind"),
            x["s"].alias("s"), *[x[c].alias(c) for c in also],
        ),
    )


def _on_text(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: test(x["s"])


def base_spans(text: Column) -> Column:
    """The base spans of a text, unsorted."""
    between = lambda n, a, b: (n >= a) & (n <= b)
    bare = lambda part: F.ltrim(part, F.lit("0"))
    small = lambda part: (F.length(bare(part)) <= 3) & (F.lpad(bare(part), 3, "0") <= "255")
    tests = {
        "email": (EMAIL, text.contains("@"), lambda s: F.lit(True)),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]"), lambda s: F.forall(F.split(s, r"\."), small)),
        "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), lambda s: between(F.length(_digits(s)), 12, 19) & luhn(s)),
        "phone": (PHONE, text.contains("+"), lambda s: between(F.length(_digits(s)), 9, 15)),
    }
    parts = []
    for kind, (pattern, may, test) in tests.items():
        good = F.filter(_located(text, pattern), _on_text(test))
        parts.append(F.when(may, _spans(good, kind)).otherwise(F.array().cast(SPAN)))
    return F.concat(*parts)


def proposals(text: Column) -> Column:
    """What the generators propose, each by itself: (start, rank, end, kind, s, before), unsorted."""
    may = {
        "key": reduce(or_, (text.contains(x) for x in KEY_HEADS)), "password": text.contains("=") | text.contains(":"), "hex": text.rlike("[0-9a-f]{16}"),
        "ssn": text.rlike("[0-9]-[0-9]{2}-[0-9]"), "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "local": text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    }
    none = F.array().cast(PROPOSAL)
    return F.concat(*[F.when(may[k], _spans(_located(text, p), k, "before")).otherwise(none) for k, p in GENERATORS.items()])


FEATURES = (
    "length", "digits", "letters", "capitals", "marks", "distinct", "value", "mixed", "equals", "masked", "keyword", "assigned", "quoted", "decoy",
    *(f"is_{k}" for k in GENERATORS),
)


def features(x: Column, before: Column) -> dict[str, Column]:
    """Format features of a proposal x (kind, s) and of the text before it."""
    s, n = x["s"], F.greatest(F.length(x["s"]), F.lit(1)).cast("double")
    share = lambda drop: F.length(F.regexp_replace(s, drop, "")) / n
    value = F.regexp_replace(s, r"^[A-Za-z_]+[\x20]?[=:][\x20]?", "")
    near = F.lower(before)
    has = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    out = {
        "length": n, "digits": share("[^0-9]"), "letters": share("[^A-Za-z]"), "capitals": share("[^A-Z]"), "marks": share("[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(s, ""))).cast("double"),
        "value": F.length(value).cast("double"), "mixed": has(value.rlike("[0-9]") & value.rlike("[A-Za-z]")), "equals": has(s.contains("=")), "masked": has(value.rlike(r"^(?:(.)\1*+|[<\[{$%].*|.*\*\*.*)$")),
        "keyword": has(near.rlike(r"key|token|secret|passw|pwd|auth|ssn|social|iban|account|phone|tel|call|mobile|aws")),
        "assigned": has(near.rlike(r"[=:]\s?[\"']?$")), "quoted": has(near.rlike(r"[\"']$")),
        "decoy": has(near.rlike(r"version|commit|sha|md5|isbn|invoice|order|revision|checksum|example|part no|serial")),
    }
    return out | {f"is_{k}": has(x["kind"] == k) for k in GENERATORS}


# ---- gradient boosting


@dataclass
class Trees:
    base: float
    trees: list  # nested (feature, threshold, left, right) or a float
    thresholds: dict[str, float]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float = 20.0):
    value = lambda i: float(g[i].sum() / (h[i].sum() + 1.0))

    def split(i: np.ndarray, d: int):
        if d == 0 or len(i) < 2:
            return value(i)
        best = (1e-6, None)
        total_g, total_h = g[i].sum(), h[i].sum()
        for f in range(x.shape[1]):
            order = i[np.argsort(x[i, f], kind="stable")]
            v = x[order, f]
            cg, ch, n = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1], np.arange(1, len(i))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(i) - n >= least)
            if not ok.any():
                continue
            gain = np.where(ok, cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, float((v[k] + v[k + 1]) / 2)))
        if best[1] is None:
            return value(i)
        f, t = best[1]
        return f, t, split(i[x[i, f] <= t], d - 1), split(i[x[i, f] > t], d - 1)

    return split(np.arange(len(x)), depth)


def _run(tree, x: np.ndarray) -> np.ndarray:
    """The tree's value for each row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = _run(tree[2], x[low]), _run(tree[3], x[~low])
    return out


def boost(x: np.ndarray, y: np.ndarray, kinds: list[str], rounds: int = 25, depth: int = 3, rate: float = 0.3, precision: float = 0.97) -> Trees:
    """Boosted trees on two thirds of the rows; the lowest thresholds of at least that precision on the rest."""
    unseen = np.arange(len(x)) // len(set(kinds)) % 3 == 2  # the kinds take turns
    a, ya = x[~unseen], y[~unseen]
    share = ya.mean()
    base = float(np.log(share / (1 - share)))
    z, trees = np.full(len(a), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(a, ya - p, p * (1 - p), depth)
        z += rate * _run(tree, a)
        trees.append(tree)
    scores = base + rate * sum(_run(t, x) for t in trees)
    thresholds = {}
    for kind in dict.fromkeys(kinds):
        i = unseen & (np.array(kinds) == kind)
        order = np.argsort(-scores[i], kind="stable")
        s, hit = scores[i][order], np.cumsum(y[i][order])
        good = np.flatnonzero((hit / np.arange(1, len(s) + 1) >= precision) & (y[i][order] == 1))
        thresholds[kind] = float(s[good[-1]]) - 1e-9 if len(good) else float("inf")  # the expression sums in another order
    return Trees(base, [(rate, t) for t in trees], thresholds)


def score(trees: Trees, f: Column) -> Column:
    """The trees as an expression over a struct of features."""

    def walk(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(f[FEATURES[tree[0]]] <= tree[1], walk(tree[2])).otherwise(walk(tree[3]))

    total = F.lit(trees.base)
    for rate, tree in trees.trees:
        total = total + F.lit(rate) * walk(tree)
    return total


def synthetic(n: int = TRAINING_ROWS, seed: int = 3) -> list[dict]:
    """Proposals with what stands before them, and whether they are personal or secret."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    plain = lambda: " ".join(pick(lower, r.randint(2, 9)) for _ in range(5)) + " "
    rows = []
    for i in range(n):
        kind, real = list(GENERATORS)[i % len(GENERATORS)], r.random() < 0.6
        cue = plain()
        if kind == "key":
            s = r.choice(["AKIA", "ASIA", "ghp_", "sk-"]) + (pick(upper + digit, 16) if real else r.choice([pick(upper[0], 14), pick("X-_", 14), pick(lower, 13)]))
            cue += r.choice(["", "key: ", "aws "]) if real else r.choice(["", "example "])
        elif kind == "password":
            words = lambda k, by: by.join(pick(lower, r.randint(4, 8)) for _ in range(k))
            if real:
                short = pick(lower, r.randint(3, 7)) + pick(digit, r.randint(1, 3)), pick(lower, r.randint(1, 3)) + r.choice(digit) + pick(lower + upper, r.randint(2, 4))
                s = r.choice([pick(lower + upper + digit, r.randint(8, 60)) + r.choice(digit), words(3, ""), words(3, r.choice("-_.")), *short])
            else:
                s = r.choice(["required", "********", "<hidden>", "changeme", "xxxxxxxx", "none", "true", "null", "1234", pick(digit, r.randint(4, 5)), pick(lower, r.randint(4, 9)), pick(lower, r.randint(4, 9)) + "."])
            s = r.choice(["password", "Password", "token", "api_key", "secret", "pwd", "SECRET_ACCESS_KEY", "auth_token", "token_count"]) + r.choice(["=", ": ", " = "]) + s
        elif kind == "hex":
            s = pick("0123456789abcdef", r.choice([18, 32, 40, 64])) if real else r.choice([pick("0", 20), pick("01", 18), pick("abcdef", 17), pick(digit, 17), pick("0123456789abcdef", 40)])
            if real:
                cue += r.choice(["", "token=", 'key: "', '"', "secret ", "="])
            elif len(s) == 40:
                cue += r.choice(["commit ", "sha ", "checksum ", "revision "])
        elif kind == "ssn":
            s = f"{r.randint(100, 899)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
            cue += r.choice(["ssn ", "social security ", ""]) if real else r.choice(["part no ", "order ", "invoice ", "serial "])
        elif kind == "iban":
            s = r.choice(["DE", "FR", "ES", "GB"]) + pick(digit, 18) if real else pick(upper, 2) + pick(digit, 2) + pick(upper, 14)
            cue += r.choice(["iban ", "account ", ""]) if real else ""
        else:
            s = f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}" if r.random() < 0.5 else f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}"
            cue += r.choice(["call ", "phone ", "tel ", ""]) if real else r.choice(["order ", "invoice ", "part no ", "isbn "])
        rows.append({"kind": kind, "s": s, "before": cue[-24:], "y": int(real)})
    return rows


_TRAINED: dict[int, Trees] = {}


def trained(spark: SparkSession, n: int = TRAINING_ROWS) -> Trees:
    """The trees, fitted once in a driver's life on n synthetic rows."""
    if n not in _TRAINED:
        rows = synthetic(n)
        one = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<kind:string,s:string,before:string,y:int>>")).alias("x"))
        got = one.select("x.kind", "x.y", *[v.alias(k) for k, v in features(F.col("x"), F.col("x")["before"]).items()]).collect()  # n rows
        x = np.array([[float(g[k]) for k in FEATURES] for g in got])
        _TRAINED[n] = boost(x, np.array([float(g["y"]) for g in got]), [g["kind"] for g in got])
    return _TRAINED[n]


def with_spans(docs: DataFrame, out: str) -> DataFrame:
    """docs with an array of (start, rank, end, kind, s), sorted by start, then kind."""
    trees = trained(docs.sparkSession)
    text, base, extra = (temporary(docs, x) for x in ("text", "base", "extra"))
    d = docs.withColumn(text, text_of(docs))
    d = d.withColumn(base, base_spans(F.col(text))).withColumn(extra, proposals(F.col(text)))
    least = F.create_map(*[F.lit(v) for k in GENERATORS for v in (k, trees.thresholds.get(k, float("inf")))])

    def chosen(x: Column) -> Column:
        f = F.struct(*[v.alias(k) for k, v in features(x, x["before"]).items()])
        return bound(f, lambda f: score(trees, f)) >= F.element_at(least, x["kind"])

    added = F.transform(F.filter(extra, chosen), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind", "s")]))
    spans = F.when(F.size(extra) == 0, F.sort_array(base)).otherwise(bound(F.sort_array(F.concat(F.col(base), added)), _without_covered))
    return d.withColumn(out, spans).drop(text, base, extra)


def _without_covered(spans: Column) -> Column:
    """Sorted spans without added ones that lie within one base span: these stand for them."""
    is_base = lambda x: x["rank"] < len(KINDS)
    reach = _running(F.transform(spans, lambda x: F.when(is_base(x), x["end"]).otherwise(0).cast("long")), lambda a, v: F.greatest(a, v))
    kept = bound(
        F.arrays_zip(spans.alias("s"), F.slice(reach, 1, F.size(spans)).alias("to")), lambda z: F.transform(F.filter(z, lambda y: is_base(y["s"]) | (y["s"]["end"] > y["to"])), lambda y: y["s"])
    )
    return F.when(F.exists(spans, is_base), kept).otherwise(spans)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, all spans; one row per row of docs."""
    d = with_spans(docs.select("doc_id", "text"), "spans")
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    d = held(d.select("doc_id", "spans"), "doc_id")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["rank"] < len(KINDS))
    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span (overlapping ones merged, the first one's kind) replaced by [KIND]; n_chars, where present, is renewed."""
    name = temporary(docs, "spans")
    d = held(with_spans(docs, name), *docs.columns)
    text = text_of(docs)

    def replaced(x: Column) -> Column:
        """x: spans, the end of all before each span and at last of all, and the text in chunks, so that a place is found without a walk over the text."""
        chunk = lambda i: F.coalesce(F.get(x["chunks"], i), F.lit(""))

        def part(a: Column, b: Column) -> Column:
            i, j = F.floor(a / F.lit(_CHUNK)).cast("int"), F.floor(b / F.lit(_CHUNK)).cast("int")
            at, to = (a % _CHUNK).cast("int"), (b % _CHUNK).cast("int")
            return F.when(i == j, F.substr(chunk(i), at + 1, to - at)).otherwise(
                F.concat(F.substr(chunk(i), at + 1), F.array_join(F.slice(x["chunks"], i + 2, j - i - 1), ""), F.substr(chunk(j), F.lit(1), to))
            )

        ended = F.slice(x["ends"], 1, F.size(x["spans"]))
        first = F.filter(F.arrays_zip(x["spans"].alias("s"), ended.alias("at")), lambda y: y["s"]["start"] >= y["at"])
        pieces = F.transform(first, lambda y: F.concat(part(y["at"], y["s"]["start"].cast("long")), F.lit("["), F.upper(y["s"]["kind"]), F.lit("]")))
        return F.array_join(F.concat(pieces, F.array(part(F.element_at(x["ends"], -1), x["n"]))), "")

    ends = _running(F.transform(name, lambda x: x["end"].cast("long")), lambda a, v: F.greatest(a, v))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), 0)
    whole = F.struct(F.col(name).alias("spans"), ends.alias("ends"), chunks.alias("chunks"), F.length(text).cast("long").alias("n"))
    new = F.when(F.size(name) > 0, bound(whole, replaced)).otherwise(F.col("text"))
    return d.select(*[F.coalesce(F.length(new).cast("long"), F.lit(0).cast("long")).alias(c) if c == "n_chars" else new.alias(c) if c == "text" else F.col(c) for c in docs.columns])

"""Quality rules: line-first cleaning, on DataFrame functions only.

Each line of a document is judged by punctuation, navigation and boilerplate rules; failing lines
are removed, and a document that loses too much of its text is rejected. Everything is computed
within the row, so there is no shuffle and no state that grows with the corpus.

Defined results: a null text counts as empty (0 words, base_failed, kept false); repeated rows
and rows of a null id are judged one by one; an empty table gives no rows; lines and texts of any
length are judged whole; extra columns are ignored by `quality_report` and left alone by `clean`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import held, plain_spaces, temporary, text_of, words


@dataclass(frozen=True)
class LineRules:
    #: A line with fewer words than this must end in terminal punctuation.
    unpunctuated_words: int = 4
    #: Menu separators (| › » · •) and doubled punctuation (!! ?? ## %% && ** $$) a word, above which a line fails.
    separators_per_word: float = 0.3
    marks_per_word: float = 0.4
    #: A line with more words is no boilerplate line, as it says something besides the phrase.
    boilerplate_words: int = 12
    #: Share of a document's non-space characters that may be lost.
    max_lost: float = 0.5
    #: Base conditions.
    min_words: int = 50
    max_repeat_percent: int = 50


# Menu words and boilerplate phrases that make up a line of their own.
MENU = (
    "home|about|about us|contact|contact us|login|log in|sign in|sign up|register|menu|search|next|previous|prev|back|"
    "share|tweet|print|help|faq|sitemap|site map|skip to content|read more|more|top|back to top|accueil|startseite|inicio"
)
BOILERPLATE = (
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|accept (?:all )?cookies|"
    r"enable javascript|javascript is (?:disabled|required)|lorem ipsum|subscribe to our newsletter|click here to|"
    r"powered by \w+|copyright (?:\(c\)|©|\d{4})"
)
TERMINAL = r"[.!?…:;。！？][\"'”’»)\]]*$"


def with_lines(d: DataFrame, text: str, out: str, rules: LineRules) -> DataFrame:
    """Adds an array of (line, solid: characters besides white space, worded: has a word, fails: is to be removed).

    Each step binds its values in a struct, so that nothing runs twice over a line; marks are
    counted only in texts that have any. A line's words are counted as its inner spaces and one.
    """
    # a column of its own: in a lambda it would run for each line
    mark = temporary(d, "marked")
    d = d.withColumn(mark, F.col(text).rlike(r"[|›»·•!?#%&*$]"))
    marked = F.col(mark)
    spaced = F.transform(
        F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.trim(plain_spaces(x)).alias("bare"))
    )
    many = lambda x, pattern: F.when(marked, F.regexp_count(x["bare"], F.lit(pattern))).otherwise(0)
    counted = F.transform(
        spaced,
        lambda x: F.struct(
            x["line"].alias("line"), x["bare"].alias("bare"),
            F.length(F.replace(x["bare"], F.lit(" "), F.lit(""))).alias("solid"),
            F.length(x["bare"]).alias("long"),
            many(x, "[|›»·•]").alias("separators"), many(x, "[!?#%&*$]{2,}").alias("marks"),
        ),
    )

    def verdict(x: Column) -> Column:
        n = x["long"] - x["solid"] + 1
        punctuation = (n < rules.unpunctuated_words) & ~x["bare"].rlike(TERMINAL)
        menu = x["bare"].rlike(rf"^(?i:{MENU})[ .>»|]*$")
        navigation = (x["separators"] > rules.separators_per_word * n) | menu
        phrase = F.when(n <= rules.boilerplate_words, F.lower(x["bare"]).rlike(BOILERPLATE)).otherwise(F.lit(False))
        boilerplate = (x["marks"] > rules.marks_per_word * n) | phrase
        return (x["solid"] > 0) & (punctuation | navigation | boilerplate)

    judged = F.transform(
        counted,
        lambda x: F.struct(
            x["line"].alias("line"), x["solid"].alias("solid"), (x["solid"] > 0).alias("worded"), verdict(x).alias("fails")
        ),
    )
    return d.withColumn(out, judged).drop(mark)


def _repeats(docs: DataFrame, w: str, out: str) -> DataFrame:
    """Words that lie in a 3-word window found twice or more; w names an array of words.

    The windows' hashes, with the position in their low bits, are sorted as plain longs; equal
    neighbours are candidates, and only candidates are compared as text. So the result is exact,
    and a row needs n log n steps however often its words repeat.
    """
    b, keys, cand, hits = (temporary(docs, s) for s in ("bits", "keys", "cand", "hits"))
    n = F.size(w)
    word = lambda i: F.get(F.col(w), i)
    # bits: enough for any position; the hash keeps the others
    d = docs.withColumn(b, F.length(F.bin(n.cast("long"))))
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    shifted = lambda v: F.call_function("shiftleft", v, F.col(b))
    d = d.withColumn(keys, F.sort_array(F.transform(at, lambda i: shifted(F.xxhash64(word(i), word(i + 1), word(i + 2))) + i)))
    high = lambda v: F.call_function("shiftrightunsigned", v, F.col(b))
    like = lambda x, j: F.coalesce(high(x) == high(F.get(F.col(keys), j)), F.lit(False))
    d = d.withColumn(cand, F.filter(F.col(keys), lambda x, j: like(x, j - 1) | like(x, j + 1)))
    position = lambda x: x.bitwiseAND(shifted(F.lit(1).cast("long")) - 1).cast("int")
    spelled = F.transform(
        F.transform(F.col(cand), position),
        lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("t"), i.alias("i")),
    )
    d = d.withColumn(hits, F.when(F.size(cand) > 0, F.sort_array(spelled)))
    same = lambda x, j: F.coalesce(x["t"] == F.get(F.col(hits), j)["t"], F.lit(False))
    true_hits = F.filter(F.col(hits), lambda x, j: same(x, j - 1) | same(x, j + 1))
    covered = F.flatten(F.transform(true_hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    d = d.withColumn(out, F.when(F.size(cand) > 0, F.size(F.array_distinct(covered))).otherwise(0).cast("long"))
    return d.drop(b, keys, cand, hits)


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, and the share of text the line rules take."""
    text = text_of(docs)
    d = docs.select("doc_id", text.alias("t"))
    d = d.withColumn("w", words(F.col("t")))
    d = with_lines(d, "t", "lines", rules)
    worded = F.transform(F.filter("lines", lambda x: x["worded"]), lambda x: x["line"])
    d = d.withColumn("worded", worded)
    d = d.select(
        "doc_id", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x["fails"])).cast("long").alias("n_failed_lines"),
        F.aggregate(
            F.filter("lines", lambda x: x["fails"]), F.lit(0).cast("long"), lambda a, x: a + x["solid"]
        ).alias("lost_chars"),
    )
    d = _repeats(d, "w", "n_repeat_words").drop("w")
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    kept = ~failed & (F.col("lost_chars") <= rules.max_lost * F.col("word_chars"))
    found = d.select("doc_id", *[c for c in d.columns if c != "doc_id"], failed.alias("base_failed"), kept.alias("kept"))
    return held(found, "doc_id")


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """docs without failing lines and without documents that lose too much; columns as given."""
    name = temporary(docs, "lines")
    whole_text = temporary(docs, "whole")
    d = with_lines(docs.withColumn(whole_text, text_of(docs)), whole_text, name, rules).drop(whole_text)
    solid = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["solid"])
    lost = solid(F.filter(name, lambda x: x["fails"]))
    whole = solid(F.col(name))
    left = F.array_join(F.transform(F.filter(name, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    text, keep = temporary(docs, "left"), temporary(docs, "keep")
    d = d.withColumn(keep, (whole > 0) & (lost <= rules.max_lost * whole)).withColumn(text, left).drop(name)
    d = held(d, *docs.columns).where(F.col(keep))
    return d.withColumn("text", F.col(text)).select(docs.columns)

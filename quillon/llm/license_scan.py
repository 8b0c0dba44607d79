"""Licence scans: a trained paragraph classifier, on DataFrame functions only.

Paragraphs are blocks of lines with words between lines without any. In each, the words about every
licence cue, across line ends, are classified by multinomial logistic regression on word unigrams and
bigrams; a cue's line has a finding for each family found. Only grams of the training paragraphs have
weights, so the model is sparse and of fixed size. The unknown class learns unrelated paragraphs and
wordings of invented licences. Probabilities are calibrated by a temperature, and the threshold of a
prediction is the lowest of the chosen precision, both on paragraphs the model has not seen; what is
predicted is confirmed by comparison with the family's templates.

Training happens on the driver on seeded variations of the templates and of unrelated paragraphs.
Scoring happens within the row: no shuffle, no state. Defined results: a null or empty text has no
findings; repeated rows and rows of a null id are scanned one by one; an empty table gives no rows;
texts, lines and paragraphs of any length are judged whole, by windows about each cue; extra columns
are ignored. A paragraph without any cue has no gram that speaks for a family and is unknown.
"""

from __future__ import annotations

import random
import re
from functools import cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bound, held, text_of

# Families and wordings that state them.
TEMPLATES = {
    "MIT": [
        "released under the mit license", "licensed under the mit license", "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software", "licensed under mit", "dual licensed under mit or",
    ],
    "Apache-2.0": ["licensed under the apache license version 2 0", "apache license version 2 0 january 2004", "spdx license identifier apache 2 0", "released under apache 2 0"],
    "GPL-2.0": [
        "licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0", "gpl 2 0 or later", "released under gpl v 2",
        "you can redistribute it and or modify it under the terms of the gnu general public license either version 2 of the license",
    ],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0", "gpl 3 0 or later", "released under gpl v 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license either version 3 of the license",
    ],
    "LGPL": ["licensed under the gnu lesser general public license version 2 1", "spdx license identifier lgpl 2 1", "lgpl 2 1 or later", "released under lgpl v 3"],
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0", "agpl 3 0 or later"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0", "spdx license identifier mpl 2 0", "released under mpl 2 0"],
    "BSD": [
        "redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3 clause license",
        "spdx license identifier bsd 3 clause", "distributed under the terms of the bsd 3 clause", "released under bsd 2 clause",
    ],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license"],
    "CC-BY": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC-BY-SA": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC0": ["this work is dedicated to the public domain under cc0 1 0 universal", "spdx license identifier cc0 1 0"],
    "EPL-2.0": ["made available under the terms of the eclipse public license 2 0", "licensed under the eclipse public license v 2 0", "spdx license identifier epl 2 0", "released under epl 2 0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense", "spdx license identifier unlicense"],
    "proprietary": ["all rights reserved", "copyright all rights reserved no part may be reproduced without permission"],
}
# Paragraphs with cues that state no licence.
UNRELATED = [
    "the driver showed a licence and the car was licensed in the city", "a fishing license is needed to fish in this lake",
    "permission to enter the building was granted by the owner", "the apache people lived in the south west of the country",
    "the mit campus is open to the public this week", "the warranty of the machine ends next year", "copyright law is taught in the third year",
    "poetic license lets the author bend the rules", "the general public was not allowed to redistribute the food", "he has a licence to sell drinks",
    "creative people in common rooms work well together", "her rights were reserved by the court until the trial", "version 3 of the report is out now",
    "the software is sold with a license for one year", "the gnu is a large african antelope", "source and binary stars are seen in the sky",
    "the apache tribe moved to the south in 1880", "bsd is a family of operating systems", "an apache helicopter landed at 3 0 pm", "the server runs apache on port 80", "the apache web server was restarted",
    "the new bsd kernel boots in 2 seconds",
]
UNKNOWN = "unknown"
# What any text with a cue contains in lower case; words that are a cue, and pairs of words.
CUE_PARTS = ("licen", "spdx", "copyright", "rights", "domain", "commons", "cc", "granted", "redistribut", "unencumbered")
CUE_WORD = r"licen[cs]e|^(?:spdx|ccby|unencumbered|[al]?gplv?|mpl|bsd|apache|epl)$|copyright|redistribut"
CUE_NAMES = r"(?<![a-z])(?:[al]?gplv?|mpl|bsd|apache|epl)(?![a-z])|under mit"
CUE_PAIRS = ("under mit", "mit or", "or mit", "mit and", "and mit", "rights reserved", "public domain", "creative commons", "cc by", "cc 0", "hereby granted")
# Words that name a family; with others in their place a wording is that of no family known.
NAMES = frozenset("mit apache gnu lesser affero general mozilla mpl gpl lgpl agpl bsd isc creative commons cc eclipse epl unlicense by sa nc clause".split())

# Words before and after a cue that are judged together: as far as the longest wording goes, and fewer or one side's, which tell neighbours apart.
REACH = ((24, 24), (8, 8), (0, 16), (16, 0), (4, 4))
#: Stands for a line without words, which ends a paragraph.
BREAK = "\x01"
#: Least share of right predictions among those above the threshold, on paragraphs that training has not seen.
PRECISION = 0.99


def plain(text: str) -> list[str]:
    return re.findall(r"[a-z]+|[0-9]+", text.lower())


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@cache
def trained(seed: int = 23, variations: int = 40, rounds: int = 120) -> tuple[list[str], dict[str, list[float]], list[float], float, dict[str, float]]:
    """(classes, weights by gram, bias, least probability, rates on paragraphs used for neither training nor calibration)."""
    r = random.Random(seed)
    classes = [*TEMPLATES, UNKNOWN]
    filler = [w for x in UNRELATED for w in plain(x)]
    invented = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 3)))
    wordings = [plain(x) for v in TEMPLATES.values() for x in v if NAMES & set(plain(x))]
    rows: list[tuple[set[str], int]] = []

    def add(words: list[str], c: int) -> None:
        if len(words) > 6 and r.random() < 0.4:  # as a window about a cue may cut it
            n = r.randint(5, len(words) - 1)
            at = r.randint(0, len(words) - n)
            words = words[at : at + n]
        words = [w for w in words if r.random() > 0.04] or words
        rows.append((grams([r.choice(filler) for _ in range(r.randint(0, 3))] + words + [r.choice(filler) for _ in range(r.randint(0, 3))]), c))

    for c, family in enumerate(classes):
        sources = TEMPLATES.get(family, UNRELATED)
        for source in sources:
            for _ in range(variations * 4 // len(sources)):
                add(plain(source), c)
    for words in wordings:
        for _ in range(variations // 5):
            add([invented() if w in NAMES or (w.isdigit() and r.random() < 0.5) else w for w in words], len(classes) - 1)
    r.shuffle(rows)
    vocabulary = sorted({g for x, _ in rows for g in x})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, (found, _) in enumerate(rows):
        x[i, [place[g] for g in found]] = 1
    known = np.array([c for _, c in rows])
    y = np.eye(len(classes))[known]
    fold = np.arange(len(rows)) % 5  # 0 to 2: training, 3: calibration, 4: rates
    seen = fold < 3
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    softmax = lambda z: (e := np.exp(z - z.max(1, keepdims=True))) / e.sum(1, keepdims=True)
    for _ in range(rounds):
        d = (y[seen] - softmax(x[seen] @ w + b)) / seen.sum()
        w += 4.0 * (x[seen].T @ d)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.0008, 0)  # sparse
        b += 4.0 * d.sum(0)
    z = x @ w + b
    heat = min(np.geomspace(0.1, 4, 60), key=lambda t: -np.log(softmax(z[fold == 3] / t)[np.arange((fold == 3).sum()), known[fold == 3]] + 1e-12).sum())
    p = softmax(z / heat)
    best, right, named = p.max(1), p.argmax(1) == known, p.argmax(1) != len(classes) - 1
    order = [i for i in np.argsort(-best, kind="stable") if fold[i] == 3 and named[i]]
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    least = float(best[order[int(np.flatnonzero(good)[-1])]])
    shown = (fold == 4) & named & (best >= least)
    rates = {"precision": float(right[shown].mean()), "recall": float((shown & right).sum() / ((fold == 4) & (known != len(classes) - 1)).sum())}
    weights = {g: (w[i] / heat).round(5).tolist() for g, i in place.items() if np.abs(w[i]).max() > 1e-4}
    return classes, weights, (b / heat).round(5).tolist(), least, rates


def scan(docs: DataFrame, least_overlap: float = 0.5) -> DataFrame:
    """doc_id, n_paragraphs (lines with cues), n_licenses, families (distinct, sorted), findings (`family:line` joined by commas)."""
    classes, weights, bias, least, _ = trained()
    # SQL constants: folded once when the plan is made
    text = lambda v: "'" + v + "'"  # noqa: E731  (grams, words and families hold no quotes)
    array = lambda v: f"array({','.join(v)})"
    doubles = lambda v: array(f"{x!r}D" for x in v)
    table = F.expr(f"map_from_arrays({array(map(text, weights))},{array(map(doubles, weights.values()))})")
    wordings = (array(array(map(text, sorted(set(plain(t))))) for t in v) for v in TEMPLATES.values())
    templates = F.expr(f"map_from_arrays({array(map(text, TEMPLATES))},{array(wordings)})")
    start = F.expr(doubles(bias))
    names = F.array(*[F.lit(c) for c in classes])
    d = docs.select("doc_id", F.lower(text_of(docs)).alias("low"))
    may = reduce(or_, (F.col("low").contains(x) for x in CUE_PARTS)) | F.col("low").rlike(CUE_NAMES)
    entry = lambda line, w, *wide: F.struct(line.alias("line"), w.alias("w"), *[x.alias("wide") for x in wide])
    found = lambda x: F.regexp_extract_all(x, F.lit("[a-z]+|[0-9]+"), F.lit(0))
    line_words = lambda x, i: bound(found(x), lambda v: F.when(F.size(v) > 0, F.transform(v, lambda w: entry(i, w))).otherwise(F.array(entry(i, F.lit(BREAK)))))
    words = F.flatten(F.transform(F.split("low", "\n"), line_words))

    def cues(x: Column) -> Column:
        pair = lambda t, i: F.concat_ws(" ", t["w"], F.get(x, i + 1)["w"]).isin(*CUE_PAIRS)
        return F.filter(F.transform(x, lambda t, i: F.when(t["w"].rlike(CUE_WORD) | pair(t, i), i)), lambda i: i.isNotNull())

    def about(x: Column, i: Column, before: int, after: int) -> Column:
        """The words about place i: of its line, and as far as its paragraph goes (wide, if that is more)."""
        upto = lambda v: bound(v, lambda v: bound(F.array_position(v, BREAK), lambda at: F.when(at > 0, F.slice(v, 1, (at - 1).cast("int"))).otherwise(v)))
        spoken = lambda v: F.transform(v, lambda t: t["w"])
        left, right = F.slice(x, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))), F.slice(x, i + 1, after + 1)
        line = F.get(x, i)["line"]
        own = lambda v: spoken(F.filter(v, lambda t: t["line"] == line))
        whole = F.concat(F.reverse(upto(F.reverse(spoken(left)))), upto(spoken(right)))
        return bound(
            F.struct(F.concat(own(left), own(right)).alias("own"), whole.alias("all")),
            lambda v: F.array(entry(line, v["own"], F.lit(False)), entry(line, v["all"], F.size(v["all"]) > F.size(v["own"]))),
        )

    # every cue is judged by the words about it, at each reach, in its line and across lines
    windows = lambda x: F.flatten(F.transform(cues(x), lambda i: F.concat(*[about(x, i, *n) for n in REACH])))
    kind = "array<struct<line:int,w:array<string>,wide:boolean>>"
    d = d.select("doc_id", F.when(may, bound(words, windows)).otherwise(F.array().cast(kind)).alias("windows"))
    d = held(d, "doc_id")
    words = F.array_distinct("windows")
    gram = lambda w: F.array_distinct(F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))))
    summed = F.transform(
        words,
        lambda x: F.struct(
            x["line"].alias("line"), x["w"].alias("w"), x["wide"].alias("wide"),
            F.aggregate(gram(x["w"]), start, lambda acc, g: F.coalesce(F.zip_with(acc, F.try_element_at(table, g), lambda p, q: p + q), acc)).alias("z"),
        ),
    )
    chosen = F.transform(
        summed,
        lambda x: F.struct(
            x["line"].alias("line"), x["w"].alias("w"), x["wide"].alias("wide"), F.element_at(names, F.array_position(x["z"], F.array_max(x["z"])).cast("int")).alias("family"),
            (1 / F.aggregate(x["z"], F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(x["z"])))).alias("p"),
        ),
    )
    like = lambda x: F.exists(F.try_element_at(templates, x["family"]), lambda t: F.size(F.array_intersect(t, x["w"])) >= least_overlap * F.size(t))
    confirmed = F.filter(chosen, lambda x: (x["family"] != UNKNOWN) & (x["p"] >= least) & F.coalesce(like(x), F.lit(False)))
    # across lines a family is looked for only if no line states it by itself
    narrow = lambda x: F.transform(F.filter(x, lambda y: ~y["wide"]), lambda y: y["family"])
    confirmed = bound(confirmed, lambda x: bound(narrow(x), lambda known: F.filter(x, lambda y: ~y["wide"] | ~F.array_contains(known, y["family"]))))
    # windows of one line that agree are one finding
    shown = F.array_distinct(F.transform(confirmed, lambda x: F.concat_ws(":", x["family"], x["line"].cast("string"))))
    d = d.select("doc_id", F.size(F.array_distinct(F.transform("windows", lambda x: x["line"]))).cast("long").alias("n_paragraphs"), F.when(F.size("windows") > 0, shown).alias("found"))
    d = held(d, "doc_id")
    return d.select(
        "doc_id", "n_paragraphs", F.greatest(F.size("found"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: F.substring_index(x, ":", 1)))), ","), F.lit("")).alias("families"),
        F.coalesce(F.array_join("found", ","), F.lit("")).alias("findings"),
    )

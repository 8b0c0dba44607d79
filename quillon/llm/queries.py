"""The registered queries of the training-data operators and, where SQL can express a result, its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import (
    conversation_trie, importance_sampling, license_scan, mixing, near_dedup, ogg_media, packing, periodic_runs, pii, quality_rules, simhash_dedup, suffix_dedup, toxicity,
)
from quillon.llm.common import table

#: Share of documents that importance resampling keeps.
RESAMPLED_SHARE = 0.8


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.fitted_scores(docs, table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.describe(table(spark, sf_dir, "documents"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return importance_sampling.resample(docs, table(spark, sf_dir, "labels"), RESAMPLED_SHARE)


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.report(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.report(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_rules, op2_toxicity, op3_suffix_dedup, op4_license_scan, op5_pii, op6_near_dedup, op7_packing, op8_mixing,
        op9_ogg_media, op10_importance_resampling, op11_simhash_dedup, op12_conversation_trie,
        op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


#: Words as the contracts define them, and each text's shingles of five words.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {WORDS.format("t")} AS w FROM d),
windows AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, line, regexp_replace(line, '^[\x20\x09\x0B-\x0D]+|[\x20\x09\x0B-\x0D]+$', '', 'g') AS bare
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
counted AS (SELECT *, length(regexp_replace(bare, '[\x20\x09\x0B-\x0D]', '', 'g')) AS solid, length(bare) AS long,
                   len(regexp_extract_all(bare, '[|›»·•]')) AS separators, len(regexp_extract_all(bare, '[!?#%&*$]{{2,}}')) AS marks FROM lines),
judged AS (SELECT *, solid > 0 AND (
             (long - solid + 1 < 4 AND NOT regexp_matches(bare, '{quality_rules.TERMINAL.replace("'", "''")}'))
             OR separators > 0.3 * (long - solid + 1) OR regexp_matches(bare, '^(?i:{quality_rules.MENU})[ .>»|]*$')
             OR marks > 0.4 * (long - solid + 1) OR (long - solid + 1 <= 12 AND regexp_matches(lower(bare), '{quality_rules.BOILERPLATE}'))) AS fails FROM counted),
of_lines AS (SELECT r, count(*) FILTER (WHERE solid > 0) - count(DISTINCT line) FILTER (WHERE solid > 0) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_failed_lines,
                    coalesce(sum(solid) FILTER (WHERE fails), 0) AS lost_chars FROM judged GROUP BY r),
found AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_failed_lines AS BIGINT) AS n_failed_lines,
                 CAST(lost_chars AS BIGINT) AS lost_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w JOIN of_lines USING (r) LEFT JOIN repeats USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * word_chars AS kept FROM found"""

OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS component_id FROM c GROUP BY id) m ON m.id = d.doc_id"""


#: The unsigned CRC-32 of a number's decimal digits, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(8 * length(CAST({0} AS VARCHAR))), lambda k: (ord(CAST({0} AS VARCHAR)[k // 8 + 1]) >> (k % 8)) & 1)),
           lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""

OP12_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), digest) AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id AS c, count(*) AS n, {CRC.format("conv_id")} % 9 AS h, conv_id - conv_id % 5 AS p FROM t GROUP BY conv_id),
b AS (SELECT k.c, k.n, k.h, k.p, least(k.h, coalesce(q.n, 0)) AS lent FROM k LEFT JOIN k q ON q.c = k.p),
r AS (SELECT b.c, t.pos, t.digest, strlen(t.text) AS bytes FROM b JOIN t ON t.conv_id = b.p AND t.pos <= b.lent
      UNION ALL SELECT b.c, t.pos - b.h + b.lent, t.digest, strlen(t.text) FROM b JOIN t ON t.conv_id = b.c AND t.pos > b.h),
l AS (SELECT c, lent + greatest(n - h, 0) AS len FROM b),
f AS (SELECT c, pos AS d, bytes, string_agg(digest, '') OVER (PARTITION BY c ORDER BY pos) AS prefix FROM r UNION ALL SELECT c, 0, 0, '' FROM l),
e AS (SELECT prefix, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM f JOIN l USING (c) WHERE d = len GROUP BY prefix),
n AS (SELECT prefix, min(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes FROM f GROUP BY prefix),
o AS (SELECT left(prefix, length(prefix) - 64) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN o USING (prefix)),
s AS (SELECT u.prefix, sum((v.n_convs - 1) * v.bytes) AS saved_tokens, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves FROM x v JOIN f u ON u.c = v.conv_id AND u.d <= v.depth GROUP BY u.prefix)
SELECT CAST(x.conv_id AS BIGINT) AS conv_id, CAST(x.depth AS BIGINT) AS depth, CAST(up.conv_id AS BIGINT) AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs,
       CAST(x.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM x JOIN s USING (prefix) LEFT JOIN n up ON x.depth > 0 AND up.prefix = left(x.prefix, length(x.prefix) - 64) LEFT JOIN e ON e.prefix = x.prefix"""

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w, {CRC.format("doc_id")} AS h FROM documents),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p),
i AS (SELECT r, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM t),
g AS (SELECT r, n, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM i WINDOW o AS (PARTITION BY r ORDER BY i)),
-- places where three words come again q words on, and stretches of them: shorter ones can't be runs
m AS (SELECT x.r, y.i - x.i AS q, x.i FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
b AS (SELECT r, q, min(i) AS start, count(*) + q + 2 AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m) GROUP BY r, q, island),
runs AS (SELECT * FROM b WHERE length >= greatest(6, 4 * q) QUALIFY row_number() OVER (PARTITION BY r, start, length ORDER BY q) = 1),
gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs),
c AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM i ANTI JOIN gone USING (r, i) GROUP BY r),
s AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS told FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / q DESC, start, q) = 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * length // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN s USING (r) LEFT JOIN best USING (r) LEFT JOIN c USING (r)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the results that it can give whole. The others have columns that a trained model, a codec, a digest of

    bytes or a pseudorandom draw decides, and are tested against brute force in tests/llm.
    """
    return {"op1_quality_rules": OP1_SQL, "op6_near_dedup": OP6_SQL, "op12_conversation_trie": OP12_SQL, "op13_periodic_runs": OP13_SQL}

"""Scalar functions by family: strings, expressions, URLs, dates, numbers, arrays, JSON, maps, hashes."""

from __future__ import annotations

from quillon.plans.registry import Registry

registry = Registry()

registry.spark_sql(
    "fn_strings", "part",
    """SELECT p_partkey, upper(p_name) AS u, substring(p_name, 1, 3) AS s, replace(p_brand, '#', '-') AS r, lpad(p_type, 12, '*') AS l, reverse(p_name) AS v,
              trim(concat(' ', p_name, ' ')) AS t, repeat(p_brand, 2) AS rr, CAST(length(p_name) AS BIGINT) AS n, md5(lower(p_name)) AS h,
              split_part(p_name, ' ', 1) AS first_word, concat_ws('/', p_brand, p_type) AS path, CAST(levenshtein(p_brand, p_type) AS BIGINT) AS d FROM {part}""",
)
registry.spark_sql(
    "fn_regex", "documents",
    "SELECT doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS w, md5(regexp_replace(text, '[0-9]+', '#')) AS masked, CAST(size(split(trim(text), '\\\\s+')) AS BIGINT) AS n FROM {documents}",
    "SELECT doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS w, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked, CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS BIGINT) AS n FROM documents",
)
registry.spark_sql(
    "fn_url", "pages", "SELECT page_id, parse_url(url, 'HOST') AS host FROM {pages}",
    "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages",
)
registry.spark_sql(
    "fn_dates", "orders",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d,
              CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, CAST(datediff(o_orderdate, DATE '1995-01-01') AS BIGINT) AS days, CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS next_month,
              CAST(dayofweek(o_orderdate) AS BIGINT) AS dow FROM {orders}""",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d,
              CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS next_month,
              CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS dow FROM orders""",
)
registry.spark_sql(
    "fn_math", "lineitem",
    """SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS s, round(ln(l_quantity), 6) AS l, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_tax * 100) AS BIGINT) AS c,
              abs(l_discount - 0.05) AS a, l_orderkey % 7 AS m, round(power(l_quantity, 2), 2) AS p, CAST(sign(l_discount - 0.05) AS BIGINT) AS g, greatest(l_tax, l_discount) AS hi FROM {lineitem}""",
)
registry.spark_sql(
    "fn_arrays", "embeddings",
    """SELECT vec_id, array_max(embedding) AS hi, array_min(embedding) AS lo, CAST(size(embedding) AS BIGINT) AS n, element_at(slice(embedding, 2, 3), 1) AS second,
              round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * x), 4) AS sq, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS pos FROM {embeddings}""",
    """SELECT vec_id, list_max(embedding) AS hi, list_min(embedding) AS lo, CAST(len(embedding) AS BIGINT) AS n, embedding[2] AS second,
              round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS sq, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS pos FROM embeddings""",
)
registry.spark_sql(
    "fn_json", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k AS k2, variant_get(parse_json(props), '$.k', 'bigint') AS k3 FROM {events}",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k2, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k3 FROM events",
)
registry.spark_sql(
    "fn_maps", "nation", "SELECT n_nationkey, element_at(map('name', n_name, 'key', CAST(n_nationkey AS STRING)), 'name') AS v, array_join(array_sort(map_keys(map_filter(map('a', n_nationkey, 'b', n_regionkey), (k, x) -> x > 2))), '') AS big FROM {nation}",
    "SELECT n_nationkey, n_name AS v, concat(CASE WHEN n_nationkey > 2 THEN 'a' ELSE '' END, CASE WHEN n_regionkey > 2 THEN 'b' ELSE '' END) AS big FROM nation",
)
registry.spark_sql("fn_hashes", "part", "SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s FROM {part}", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part")
registry.spark_sql(
    "text_exact_dedup", "documents",
    # digests and lengths are shuffled, not texts
    "SELECT min(doc_id) AS doc_id, min(m) AS h, CAST(count(*) AS BIGINT) AS copies FROM (SELECT doc_id, md5(text) AS m, sha2(text, 256) AS d, length(text) AS n FROM {documents}) GROUP BY d, n",
    "SELECT min(doc_id) AS doc_id, md5(text) AS h, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY text",
)
registry.spark_sql(
    "text_strip_tags", "pages", "SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '')) AS h FROM {pages}", "SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS h FROM pages",
)
registry.spark_sql(
    "vector_norms", "embeddings", "SELECT vec_id, label, round(sqrt(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * x)), 4) AS norm FROM {embeddings}",
    "SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm FROM embeddings",
)
registry.spark_sql(
    "fn_url_parts", "pages",
    "SELECT page_id, parse_url(url, 'PROTOCOL') AS protocol, parse_url(url, 'PATH') AS path, coalesce(parse_url(url, 'QUERY'), '') AS query, coalesce(parse_url(url, 'REF'), '') AS ref FROM {pages}",
    """SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS protocol, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
              regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS ref FROM pages""",
)
registry.spark_sql(
    "fn_arrays_more", "embeddings",
    """SELECT vec_id, CAST(size(array_distinct(transform(embedding, x -> floor(x * 10)))) AS BIGINT) AS d, element_at(sort_array(embedding), 1) AS lo,
              element_at(sort_array(embedding, false), 1) AS hi, round(element_at(transform(embedding, x -> CAST(x AS DOUBLE) * 2), 3), 4) AS third,
              CAST(size(array_union(slice(embedding, 1, 4), slice(embedding, 3, 4))) AS BIGINT) AS u, exists(embedding, x -> x > 0) AS some FROM {embeddings}""",
    """SELECT vec_id, CAST(len(list_distinct(list_transform(embedding, lambda x: floor(x * 10)))) AS BIGINT) AS d, list_min(embedding) AS lo, list_max(embedding) AS hi,
              round(CAST(embedding[3] AS DOUBLE) * 2, 4) AS third, CAST(len(list_distinct(list_concat(embedding[1:4], embedding[3:6]))) AS BIGINT) AS u,
              len(list_filter(embedding, lambda x: x > 0)) > 0 AS some FROM embeddings""",
)
registry.spark_sql(
    "fn_json_more", "events", """SELECT event_id, j.c0 AS k, to_json(named_struct('k', CAST(get_json_object(props, '$.k') AS INT), 't', event_type)) AS o FROM {events} LATERAL VIEW json_tuple(props, 'k') j AS c0""",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, '{"k":' || json_extract_string(props, '$.k') || ',"t":"' || event_type || '"}' AS o FROM events""",
)
registry.spark_sql(
    "fn_maps_more", "nation",
    """SELECT n_nationkey, array_join(map_values(map_from_entries(array(named_struct('k', 'a', 'v', n_name), named_struct('k', 'b', 'v', upper(n_name))))), '/') AS vs,
              transform_values(map('a', n_nationkey), (k, v) -> v * 2)['a'] AS twice, map_zip_with(map('a', n_nationkey), map('a', n_regionkey), (k, x, y) -> x + y)['a'] AS both,
              array_join(map_keys(transform_keys(map('a', 1), (k, v) -> upper(k))), '') AS ks FROM {nation}""",
    "SELECT n_nationkey, n_name || '/' || upper(n_name) AS vs, n_nationkey * 2 AS twice, n_nationkey + n_regionkey AS \"both\", 'A' AS ks FROM nation",
)
#: The unsigned CRC-32 of a text's bytes (here ASCII), bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(8 * length(p_name)), lambda k: (ord(p_name[k // 8 + 1]) >> (k % 8)) & 1)),
              lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""
registry.spark_sql(
    "fn_hashes_more", "part",
    # xxhash64 and murmur3 by the values that Spark's documentation gives
    """SELECT p_partkey, crc32(CAST(p_name AS BINARY)) AS crc, sha1(p_name) AS sha, xxhash64('Spark', array(123), 2) AS xx, hash('Spark', array(123), 2) AS murmur,
              hex(p_name) AS digits, base64(CAST(p_name AS BINARY)) AS letters FROM {part}""",
    f"""SELECT p_partkey, {_CRC} AS crc, sha1(p_name) AS sha, CAST(5602566077635097486 AS BIGINT) AS xx, CAST(-1321691492 AS INTEGER) AS murmur,
               hex(p_name) AS digits, base64(encode(p_name)) AS letters FROM part""",
)

"""DuckDB SQL that gives the rows of queries from the tables alone, by other means than the operators."""

from __future__ import annotations

from .secret_scans import RULES
from .sharding import SHARDS
from .suffix_dedup import LENGTH

#: op2: every string of LENGTH bytes, as hex digits, is grouped with its equals; runs of covered bytes go.
SUFFIX_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, hash(substring(h, (2 * i + 1)::bigint, {2 * LENGTH})) AS k FROM d, unnest(range(0, length(h) // 2 - {LENGTH} + 1)) AS u(i)),
t AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
m AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM s SEMI JOIN t USING (k)),
n AS (SELECT r, i, sum(CASE WHEN gap <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM m),
p AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM n GROUP BY r, run),
q AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS was FROM p),
k AS (SELECT r, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substring(h, (2 * was + 1)::bigint, (2 * (a - was))::bigint), '' ORDER BY a) AS kept FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(gone, 0)::bigint AS n_removed, coalesce(spans, 0)::bigint AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, (2 * coalesce(last, 0) + 1)::bigint))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def secrets() -> str:
    """op8: each rule's matches and what lies between them; places are sums of their lengths."""
    found = []
    for k, (_, pattern, measure, least, _) in enumerate(RULES):
        size = "length(m)"
        if measure == "tail":
            head = pattern[: pattern.rindex("[")]
            size = f"length(m) - length(regexp_extract(m, {_quoted('^' + head)}))"
        found.append(f"""SELECT r, {k} AS k, z - length(m) AS s, z AS e FROM (
  SELECT r, m, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY r ORDER BY i) AS z FROM (
    SELECT r, unnest(regexp_extract_all(x, {_quoted(pattern)})) AS m, unnest(regexp_split_to_array(x, {_quoted(pattern)})) AS gap, generate_subscripts(regexp_split_to_array(x, {_quoted(pattern)}), 1) AS i FROM d))
  WHERE m IS NOT NULL AND {size} >= {least}""")
    kinds, base = str([r[0] for r in RULES]), sum(r[4] for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
f AS ({" UNION ALL ".join(found)}),
g AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
        string_agg(({kinds})[k + 1] || ':' || s::bigint || ':' || e::bigint, ',' ORDER BY s, k) AS listed,
        string_agg(({kinds})[k + 1] || ':' || s::bigint || ':' || e::bigint, ',' ORDER BY s, k) FILTER (k < {base}) AS based FROM f GROUP BY r)
SELECT doc_id, coalesce(a, 0)::bigint AS n_assign, coalesce(b, 0)::bigint AS n_access, coalesce(c, 0)::bigint AS n_hex, sha256(coalesce(based, '')) AS base_sha256, coalesce(listed, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


def sharding() -> str:
    """op10: crc32 byte by byte from its table; jump consistent hashing step by step."""
    step = "(k * 2862933555777941757::uhugeint + 1::uhugeint) % 18446744073709551616::uhugeint"
    jump = "floor((b + 1) * (2147483648.0 / ((({}) // 8589934592::uhugeint)::double + 1.0)))"
    return f"""
WITH RECURSIVE bits AS (SELECT list(t ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) AS u(n))),
d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, coalesce(octet_length(encode(text)), 0) + 8 AS size FROM documents),
c AS (SELECT r, doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substring(h, 2 * i + 1, 2))::bigint)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, bits),
n AS (SELECT unnest([{SHARDS}, {SHARDS + 1}]) AS shards),
j AS (SELECT r, shards, coalesce(doc_id, 0)::hugeint AS key, CASE WHEN doc_id < 0 THEN (doc_id::hugeint + 18446744073709551616)::uhugeint ELSE coalesce(doc_id, 0)::uhugeint END AS k, 0::double AS b, false AS done FROM c, n
  UNION ALL
  SELECT r, shards, key, {step}, CASE WHEN {jump.format(step)} < shards THEN {jump.format(step)} ELSE b END, {jump.format(step)} >= shards FROM j WHERE NOT done),
s AS (SELECT r, max(b) FILTER (shards = {SHARDS})::int AS shard, max(b) FILTER (shards = {SHARDS + 1})::int AS grown_shard FROM j GROUP BY r)
SELECT doc_id, size::bigint AS size, text_crc32::bigint AS text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::bigint AS slot, grown_shard
FROM c JOIN s USING (r)
"""

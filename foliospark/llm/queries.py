"""The queries of this package, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, fingerprints, licenses, mixing, neardup, pii, secret_scans, sharding, sql, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_decontamination": decontam.query,
        "op4_mixing": mixing.query,
        "op5_toxicity": toxicity.query,
        "op6_fingerprints": fingerprints.query,
        "op7_personal_data": pii.query,
        "op8_secrets": secret_scans.query,
        "op9_near_duplicates": neardup.query,
        "op10_sharding": sharding.query,
    }


NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS sh FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.y FROM r JOIN e ON r.c = e.x),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": sql.SUFFIX_DEDUP, "op3_decontamination": decontam.ORACLE, "op8_secrets": sql.secrets(), "op9_near_duplicates": NEAR_DUPLICATES, "op10_sharding": sql.sharding()}

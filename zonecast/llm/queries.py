"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonecast.llm.align import op13_alignment
from zonecast.llm.bpe import op1_bpe
from zonecast.llm.licences import op2_licences
from zonecast.llm.minhash import op7_minhash_dedup
from zonecast.llm.packing import op3_packing
from zonecast.llm.periodic import op11_periodic_runs
from zonecast.llm.pii import op10_pii
from zonecast.llm.quality_model import op8_quality_classifier
from zonecast.llm.quality_rules import op6_quality_rules
from zonecast.llm.secrets import OP12_SQL, op12_secrets
from zonecast.llm.toxicity import op5_toxicity
from zonecast.llm.vectors import op9_vector_dedup
from zonecast.llm.warc import OP4_SQL, op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_licences": op2_licences,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_pii": op10_pii,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secrets": op12_secrets,
    "op13_alignment": op13_alignment,
}

#: Everything a node reaches along links (a, b), both ways; its component is the smallest of it.
_REACHED = "reached(node, other) AS (SELECT DISTINCT a, b FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other)"

OP7_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in generate_series(1, len(w) - 2)] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
{_REACHED},
top AS (SELECT node, min(other) AS other FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(other, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN top ON node = d.doc_id
"""

OP9_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.9),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
{_REACHED},
top AS (SELECT node, min(other) AS other FROM reached GROUP BY 1)
SELECT d.vec_id, coalesce(n, 0) AS n_links, least(d.vec_id, coalesce(other, d.vec_id)) AS component_id,
  d.vec_id = least(d.vec_id, coalesce(other, d.vec_id)) AS kept
FROM embeddings d LEFT JOIN counts ON a = d.vec_id LEFT JOIN top ON node = d.vec_id
"""

ORACLE: dict[str, str] = {"op4_warc": OP4_SQL, "op7_minhash_dedup": OP7_SQL, "op9_vector_dedup": OP9_SQL, "op12_secrets": OP12_SQL}

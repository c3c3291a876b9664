"""Queries of the training-data operators: ``opN_<name>`` over whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusfold.llm.decontaminate import op4_benchmark_leaks
from corpusfold.llm.hard_negatives import op12_hard_negatives
from corpusfold.llm.language_id import op6_language_id
from corpusfold.llm.ngram_join import op9_ngram_jaccard_join
from corpusfold.llm.packing import op13_cost_packing
from corpusfold.llm.source_mix import op3_source_mix
from corpusfold.llm.substring_dedup import op1_substring_dedup
from corpusfold.llm.token_counts import op7_token_counts
from corpusfold.llm.token_files import op2_token_files
from corpusfold.llm.topk_search import op5_topk_search
from corpusfold.llm.toxicity import op8_toxicity
from corpusfold.llm.vector_codes import op11_vector_codes
from corpusfold.llm.warc import op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_files": op2_token_files,
    "op3_source_mix": op3_source_mix,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_topk_search": op5_topk_search,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_cost_packing": op13_cost_packing,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# four rounds: each part to its nearest entry, then each entry to the floor of its parts' mean; then once more
_NEAREST = """
  a{i} AS MATERIALIZED (SELECT r, p, x, m.d AS d, m.e AS e FROM (
         SELECT r, p, any_value(x.x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(x.x, c.x),
                lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.e)) AS m FROM x JOIN c{i} c USING (p) GROUP BY r, p))"""
_MOVED = """,
  m{i} AS (SELECT p, e, k, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y
           FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS k FROM a{i}) GROUP BY p, e, k),
  c{j} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.x, c.x) AS x FROM c{i} c
         LEFT JOIN (SELECT p, e, list(y ORDER BY k) AS x FROM m{i} GROUP BY p, e) n USING (p, e)),"""
_CODE_ROUNDS = "".join(_NEAREST.format(i=i) + (_MOVED.format(i=i, j=i + 1) if i < 4 else "") for i in range(5))

ORACLE: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d),
  k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY list_slice(w, i, i + 19) ORDER BY doc_id, i) AS nth FROM p),
  cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM k WHERE nth > 1),
  each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
  kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n
           FROM each e ANTI JOIN cut c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op9_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS g FROM d),
  e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
  o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
        GROUP BY ALL),
  l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * k >= 85 * (n + m - k) UNION SELECT b, a FROM o WHERE 100 * k >= 85 * (n + m - k)),
  r(v, u) AS (SELECT a, b FROM l UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(u), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON r.v = s.doc_id GROUP BY s.doc_id, g""",
    "op5_topk_search": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
  k AS (SELECT body, max(page_id) AS keeper FROM p WHERE octet_length(encode(body)) >= 1000 GROUP BY body)
SELECT page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.body = k.body""",
    "op12_hard_negatives": """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.w, c.w) AS BIGINT) AS score
        FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.w) = len(c.w)),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
    "op11_vector_codes": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
             list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  x AS MATERIALIZED (SELECT r, p, list_slice(w, p * len(w) // 4 + 1, (p + 1) * len(w) // 4) AS x FROM v, range(4) t(p)),
  c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM x WHERE r <= 256),{_CODE_ROUNDS}
SELECT vec_id, string_agg(printf('%02x', a.e), '' ORDER BY a.p) AS code, CAST(sum(a.d) AS BIGINT) AS error,
       CAST(sum(sum(a.d)) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c4) AS codebooks_sha256
FROM a4 a JOIN v USING (r) GROUP BY r, vec_id, label""",
}

"""SQL of the queries that SQL can express; DuckDB runs it on the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op9_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""

ORACLES["op6_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, CASE WHEN contains(text, '<|') OR regexp_matches(text, '<\\+\|') THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END AS shown FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(shown) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op2_mix_sources"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN CAST(5 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight, CAST(2 AS DOUBLE) * source_size AS most FROM s
), f AS (
  SELECT *, most / weight AS full_at,
    (CAST(1.5 AS DOUBLE) * (sum(source_size) OVER ()) - (sum(most) OVER (ORDER BY most / weight, i) - most)) / sum(weight) OVER (ORDER BY most / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), goals AS (
  SELECT i, source, source_size, least(most, weight * first_value(CASE WHEN level <= full_at THEN level END IGNORE NULLS) OVER (ORDER BY full_at, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS target FROM f
), plan AS (
  SELECT greatest(1, CAST(ceil(floor(sum(target)) / 1048576.0) AS BIGINT)) AS block, CAST(round_even(sum(target), 0) AS BIGINT) AS wanted FROM goals
), ranges AS (
  SELECT i, source, source_size, target, high, lag(high, 1, 0.0) OVER (ORDER BY i) AS low
  FROM (SELECT *, sum(target) OVER (ORDER BY i) / sum(target) OVER () AS high FROM goals)
), slots AS (
  SELECT CAST(x AS DOUBLE) * CAST(0.6180339887498949 AS DOUBLE) - floor(CAST(x AS DOUBLE) * CAST(0.6180339887498949 AS DOUBLE)) AS u
  FROM plan, unnest(range(0, (wanted + block - 1) // block)) AS r(x)
), hits AS (
  SELECT r.i, count(s.u) AS hits FROM ranges r LEFT JOIN slots s ON s.u >= r.low AND s.u < r.high GROUP BY r.i
), n AS (
  SELECT source, source_size, target, block, (source_size + block - 1) // block AS blocks, least(hits, 2 * ((source_size + block - 1) // block)) AS slots
  FROM ranges JOIN hits USING (i), plan
), c AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY place, row) - size AS first FROM d
)
SELECT c.doc_id, c.size, n.source_size, n.target,
  CAST(CASE WHEN c.size = 0 THEN 0 ELSE c.size * (n.slots // greatest(n.blocks, 1))
    + greatest(0, least(c.first + c.size, (n.slots % greatest(n.blocks, 1)) * n.block) - c.first) END AS BIGINT) AS taken
FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source
"""

"""DuckDB SQL for the ``opN_`` queries that SQL expresses over whole tables.

The fitted operators (2, 4, 6, 8), the encoders (1, 3, 9), the scan (5) and those
that hash by crc32 (11, 12) have none: the tests hold them against brute-force versions.
"""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of 5-word shingles, pairs by an inverted index, components by a recursive walk over the links.
JACCARD = f"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(COALESCE({_LOWER}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s
  FROM words
),
nodes AS (
  SELECT MIN(doc_id) OVER (PARTITION BY s) AS node, doc_id, len(s) AS n, s,
         CASE WHEN len(s) > 0 THEN COUNT(*) OVER (PARTITION BY s) ELSE 1 END AS copies
  FROM sets
),
entries AS (SELECT node, n, UNNEST(s) AS g FROM nodes WHERE doc_id = node AND n > 0),
links AS (
  SELECT a.node AS x, b.node AS y
  FROM entries a JOIN entries b ON a.g = b.g AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))
),
reach AS (
  SELECT DISTINCT x AS node, x AS spot FROM links
  UNION
  SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.spot
),
low AS (SELECT node, MIN(spot) AS component FROM reach GROUP BY node)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles,
       CASE WHEN d.n = 0 THEN d.doc_id ELSE COALESCE(l.component, d.node) END AS component_id, CAST(d.copies AS BIGINT) AS n_copies
FROM nodes d LEFT JOIN low l USING (node)"""

#: All scores of the queries, ranked.
TOP_K = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""

_ESCAPED = r"""regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"""

#: Turns, loss text and the length of the template around the escaped texts: marks of each text, of each block.
CHAT = f"""WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
),
placed AS (SELECT *, LAG(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens FROM turns)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM(length({_ESCAPED.format("text")}) + 13 + CASE WHEN opens THEN length({_ESCAPED.format("role")}) + 8 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""

ORACLE: dict[str, str] = {"op7_ngram_jaccard_join": JACCARD, "op10_topk_search": TOP_K, "op13_chat_formatting": CHAT}

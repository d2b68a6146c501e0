"""SQL of the operators that it can express, for DuckDB, over whole tables."""

from __future__ import annotations

_COMPONENTS = """
reach AS (
  SELECT id, id AS other FROM nodes
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
),
components AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

VECTORS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT id, e FROM nodes
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.id AS a, y.id AS b FROM usable x, usable y
  WHERE x.id <> y.id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9
),{_COMPONENTS},
degrees AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT c.id AS vec_id, coalesce(d.n, 0) AS n_links, c.component_id, c.id = c.component_id AS kept
FROM components c LEFT JOIN degrees d ON c.id = d.id
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
nodes AS (SELECT id FROM worded),
shingles AS (
  SELECT DISTINCT id, s FROM (
    SELECT id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s
    FROM worded WHERE len(w) > 0
  )
),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (
  SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)
),{_COMPONENTS}
SELECT c.id AS doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, c.id = c.component_id AS kept
FROM components c LEFT JOIN sizes s ON c.id = s.id
"""

#: Texts as hexadecimal digits, two a byte; windows are read from pieces of 500 bytes, so that a long text isn't walked for each.
REPEATS = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (
  SELECT doc_id, n, p, substr(h, 2 * p + 1, 1200) AS piece FROM (SELECT doc_id, h, n, unnest(range(0, n, 500)) AS p FROM raw)
),
windows AS (
  SELECT doc_id, p + o AS start, md5(substr(piece, 2 * o + 1, 200)) AS w
  FROM (SELECT doc_id, n, p, piece, unnest(range(0, 500)) AS o FROM pieces)
  WHERE p + o + 100 <= n
),
again AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY w ORDER BY doc_id, start) AS k FROM windows) WHERE k > 1
),
marked AS (SELECT doc_id, start, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= 100 THEN 0 ELSE 1 END AS opens FROM again),
numbered AS (SELECT doc_id, start, sum(opens) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM marked),
spans AS (SELECT doc_id, run, min(start) AS a, max(start) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
),
kept AS (
  SELECT g.doc_id, string_agg(CASE WHEN g.y IS NULL THEN substr(r.h, 2 * g.x + 1) ELSE substr(r.h, 2 * g.x + 1, 2 * (g.y - g.x)) END, '' ORDER BY g.x) AS h
  FROM gaps g JOIN raw r ON r.doc_id = g.doc_id GROUP BY g.doc_id
),
removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT r.doc_id, CAST(r.n AS BIGINT) AS n_bytes, CAST(coalesce(d.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(d.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k.h, r.h))) AS kept_sha256
FROM raw r LEFT JOIN removed d ON d.doc_id = r.doc_id LEFT JOIN kept k ON k.doc_id = r.doc_id
"""

ORACLE_SQL = {"op2_embedding_near_dedup": VECTORS, "op3_suffix_dedup": REPEATS, "op8_minhash_near_dedup": NEAR_DUPLICATES}

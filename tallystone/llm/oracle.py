"""DuckDB SQL of this subpackage's queries, where SQL can express them; the others are tested against brute force."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Only A-Z are lower-cased.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (q.n * c.n) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""

OP4 = rf"""WITH d AS (SELECT doc_id, source, text, {WORDS} AS ws FROM documents),
 windows AS (SELECT doc_id, i, ws[i:i+4] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
 often AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
 rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM often) GROUP BY 1),
 lines AS (SELECT doc_id, source, text, line, array_to_string(regexp_extract_all({LOWER.format('line')}, '[^\x20\x09-\x0D]+'), ' ') AS norm FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
 full_lines AS (SELECT *, len(string_split(norm, ' ')) AS w FROM lines WHERE norm <> ''),
 dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY 1),
 frequent AS (SELECT source, norm, min(doc_id) AS first FROM full_lines GROUP BY 1, 2 HAVING count(DISTINCT text) > 20),
 gone AS (SELECT l.doc_id, sum(w) AS n FROM full_lines l JOIN frequent f ON l.source = f.source AND l.norm = f.norm AND l.doc_id <> f.first GROUP BY 1),
 b AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(gone.n, 0))::BIGINT AS n_words_left FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
 SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words_left >= 10 AND n_words_left >= 0.2 * n_words AS kept FROM b"""

OP7 = rf"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i+4] END, ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
 SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""

OP8 = rf"""WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS ss, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM d GROUP BY 1),
 o AS (SELECT *, 3.0::DOUBLE * ss AS cap, 3.0::DOUBLE * ss / w AS ratio FROM s),
 p AS (SELECT *, row_number() OVER (ORDER BY ratio, source) AS k, coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed, sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, sum(ss) OVER () AS total FROM o),
 level AS (SELECT (total - closed) / open_w AS level FROM p WHERE (total - closed) / open_w <= ratio ORDER BY k LIMIT 1),
 t AS (SELECT source, ss, least(cap, w * (SELECT level FROM level)) AS target FROM p), q AS (SELECT *, CASE WHEN ss > 0 THEN floor(round(target, 6) / ss)::BIGINT ELSE 0 END AS whole FROM t),
 x AS (SELECT d.*, ss, target, whole, greatest(0, round(target)::BIGINT - whole * ss) AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
 SELECT doc_id, size, ss AS source_size, target, (whole * size + CASE WHEN whole < 3 THEN greatest(0, least(size, rest - before)) ELSE 0 END)::BIGINT AS taken FROM x"""

ORACLES: dict[str, str] = {"op3_nearest_codes": OP3, "op4_line_quality": OP4, "op7_jaccard_join": OP7, "op8_mixing": OP8}

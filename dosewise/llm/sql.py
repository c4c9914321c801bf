"""DuckDB SQL of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_line_quality"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1) || 'none') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
repw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
         translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d)),
held AS (SELECT * FROM lines WHERE nw > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM held GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT t) AS n_host FROM d GROUP BY host),
above AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS n FROM held GROUP BY host, norm) JOIN hosts USING (host)
          WHERE n > 20 AND n > 0.01 * n_host),
gone AS (SELECT doc_id, sum(nw) AS n_words_gone, count(DISTINCT norm) AS n_lines_gone FROM held JOIN above USING (host, norm) GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repw.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines_gone, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(n_words_gone, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repw USING (doc_id) LEFT JOIN gone USING (doc_id)),
failed AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM base)
SELECT *, (NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_removed_words > 0.5 * n_words))) AS kept
FROM failed
"""

SQL["op3_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, array_to_string(ws[i:i+3], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 4)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""

SQL["op6_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM win) WHERE doc_id > low),
gone AS (SELECT doc_id, list_distinct(list(i + k)) AS spots FROM later, (SELECT unnest(range(0, 13)) AS k) GROUP BY doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
cut AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM w JOIN gone USING (doc_id) WHERE NOT list_contains(spots, i) GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN spots IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(cut.t, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

SQL["op5_phrase_index"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
q AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i+12], ' ') AS g, 13 AS n FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM b WHERE len(ws) >= 13)
  UNION SELECT item_id, array_to_string(ws, ' '), len(ws) FROM b WHERE len(ws) BETWEEN 1 AND 12),
sizes AS (SELECT DISTINCT n FROM q),
p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n),
hit AS (SELECT p.doc_id, p.i, p.n, q.item_id FROM p JOIN q ON q.n = p.n AND q.g = array_to_string(p.ws[p.i:p.i + p.n - 1], ' ')),
cover AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL["op9_line_runs"] = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS place FROM d WHERE text IS NOT NULL),
held AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
win AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM held WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS r FROM win WHERE c IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest(range(0, 3)) AS k)),
runs AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) AS n FROM (
  SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM gone) GROUP BY doc_id, island) GROUP BY doc_id),
cut AS (SELECT doc_id, place FROM held JOIN gone USING (doc_id, pos)),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.place) AS t FROM l ANTI JOIN cut ON l.doc_id = cut.doc_id AND l.place = cut.place GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(longest, 0) AS BIGINT) AS longest_run,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL["op11_phrase_mining"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws[i:i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, g, count(*) AS a FROM g GROUP BY lang, g HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
inner_of AS (
  SELECT lang, g[i:j] AS g, max(a) AS most
  FROM (SELECT lang, g, a, i, unnest(range(i + 1, len(g) + 1)) AS j FROM (SELECT lang, g, a, unnest(range(1, len(g))) AS i FROM f WHERE len(g) > 2))
  WHERE j - i + 1 < len(g) GROUP BY 1, 2),
held AS (SELECT f.lang, f.g, f.a FROM f LEFT JOIN inner_of ON inner_of.lang = f.lang AND inner_of.g = f.g WHERE len(f.g) > 1 AND (most IS NULL OR most < a)),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM held),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:] JOIN t ON t.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM scored),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best WHERE place = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

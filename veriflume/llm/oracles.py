"""DuckDB statements of the operators that SQL can express."""

URL_FILTER = """
WITH s AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM s),
r(rule, rhost, rpath, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
SELECT h.page_id, h.host, h.path,
  (SELECT rule FROM r WHERE (h.host = rhost OR h.host LIKE '%.' || rhost) AND starts_with(h.path, rpath) ORDER BY length(rule) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM r WHERE (h.host = rhost OR h.host LIKE '%.' || rhost) AND starts_with(h.path, rpath) ORDER BY length(rule) DESC LIMIT 1), 'allow') AS verdict
FROM h
"""

DECONTAMINATE = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
occ AS (SELECT DISTINCT doc_id, dw.m AS m, i, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 100)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
dead AS (SELECT DISTINCT doc_id, p + o AS q FROM (SELECT doc_id, p FROM w JOIN f USING (h) WHERE doc_id > first), range(50) AS r(o)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE prev IS NULL OR q > prev + 1) AS n_spans FROM (SELECT doc_id, q, lag(q) OVER (PARTITION BY doc_id ORDER BY q) AS prev FROM dead) GROUP BY doc_id),
gaps AS (SELECT doc_id, a, b FROM (SELECT doc_id, coalesce(lag(q) OVER (PARTITION BY doc_id ORDER BY q) + 1, 0) AS a, q AS b FROM dead) WHERE b > a
         UNION ALL SELECT d.doc_id, max(q) + 1, any_value(n) FROM dead JOIN d USING (doc_id) GROUP BY d.doc_id HAVING max(q) + 1 < any_value(n)),
kept AS (SELECT g.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN x ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op2_url_filter": URL_FILTER, "op6_suffix_dedup": SUFFIX_DEDUP, "op10_decontaminate": DECONTAMINATE}

#: a line goes where a run with at least eight words that holds it stands earlier too, the lines before and after it alike; a
#: run of more than eight lines is the union of its runs of eight, which have a word a line at least
LINE_DEDUP = r"""
WITH raw AS (SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\t\x0B\f\r ]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS pos FROM raw),
w AS (SELECT doc_id, pos, k, array_to_string(list_slice(ls, pos + 1, pos + k), chr(10)) AS g FROM l, range(1, 9) AS s(k) WHERE pos + k <= len(ls)),
c AS (SELECT * FROM w WHERE length(g) - length(replace(translate(g, chr(10), ' '), ' ', '')) + 1 >= 8),
f AS (SELECT k, g, min((doc_id, pos)) AS first FROM c GROUP BY k, g HAVING count(*) > 1),
dead AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) AS p FROM c JOIN f USING (k, g) WHERE (doc_id, pos) > first),
g AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE prev IS NULL OR p > prev + 1) AS n_runs FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM dead) GROUP BY doc_id),
lines AS (SELECT doc_id, i, x, sum(CASE WHEN trim(regexp_replace(x, '[\t\x0B\f\r ]+', ' ', 'g')) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p, trim(regexp_replace(x, '[\t\x0B\f\r ]+', ' ', 'g')) = '' AS blank
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM raw JOIN g USING (doc_id))),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM lines LEFT JOIN dead USING (doc_id, p) WHERE blank OR dead.doc_id IS NULL GROUP BY doc_id)
SELECT raw.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, CASE WHEN n_removed IS NULL THEN raw.text ELSE coalesce(t, '') END AS text
FROM raw LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op4_line_dedup"] = LINE_DEDUP

ITQ_DEDUP = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT m.vec_id, coalesce(n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u) m LEFT JOIN (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u) k USING (vec_id)
"""

GROUP_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM inter JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u) c USING (doc_id)
"""

ORACLES |= {"op5_itq_dedup": ITQ_DEDUP, "op8_group_join": GROUP_JOIN}

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '|', '\p') AS r, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || r || chr(10) || t || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

FILTER_AUDIT = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM w GROUP BY text),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) + 4 * CAST(100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) AS INT)
        + 8 * CAST(length(translate(text, '#$%&*|', '')) < length(text) AS INT) + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS mask
      FROM w JOIN f USING (text) LEFT JOIN l ON w.doc_id = l.doc_id),
n AS (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS t FROM m GROUP BY part, mask),
b(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b1.x || c.x || d.x || e.x AS filter_order FROM b a, b b1, b c, b d, b e WHERE len(list_distinct([a.x, b1.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, bit, (SELECT coalesce(sum(q.bit), 0) FROM b q WHERE position(q.x IN filter_order) < step) AS before
      FROM o, range(1, 6) AS r(step), b WHERE b.x = substr(filter_order, CAST(step AS INT), 1)),
p AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & CAST(before + bit AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS BIGINT) = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS BIGINT) > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS BIGINT) = 0 THEN g ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS BIGINT) = 0 THEN t ELSE 0 END) AS toxic_lost
      FROM n, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM p
"""

ORACLES |= {"op11_incremental_render": CHAT, "op12_filter_audit": FILTER_AUDIT}

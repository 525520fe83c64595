"""DuckDB SQL for the contract queries that SQL expresses on whole tables."""

from __future__ import annotations

from .line_quality import _BOILERPLATE

_WORDS = r"'[^\x20\x09-\x0D]+'"
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_WORDS}), []) AS w FROM documents),
v AS (SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM v GROUP BY k HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos FROM (SELECT v.doc_id, v.s FROM v JOIN f USING (k) WHERE f.first < v.doc_id)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM p ANTI JOIN hit USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP2 = r"""
WITH u AS (SELECT page_id, html, md5(coalesce(html, '')) AS h, page_id % 4 AS nth, regexp_extract(url, '^\s*(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?', ['host', 'port', 'path', 'query']) AS x, regexp_matches(url, '^\s*(?i:https?)://(?:[^/?#@]*@)?[^/?#:@]+') AS ok FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_replace(x.query, '\s+$', ''), '&'), lambda p: p <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref', 'sid', 'phpsessid', 'jsessionid'], lower(split_part(p, '=', 1))))) AS params FROM u),
c AS (SELECT page_id, html, h, nth, CASE WHEN ok THEN regexp_replace(lower(x.host), '^www[0-9]*\.', '') || CASE WHEN x.port IN ('', '80', '443') THEN '' ELSE ':' || x.port END || '/' || regexp_replace(x.path, '^/+|/+$', '', 'g') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical_url FROM q),
mark AS (SELECT *, CASE WHEN nth IN (0, 2) THEN 'etag:"' || h || '"' WHEN nth = 1 THEN 'last-modified:' || h END AS own FROM c),
rec AS (SELECT page_id AS record_id, 'response' AS kind, canonical_url, page_id * 2 AS t, h, nth, html FROM mark UNION ALL SELECT page_id, 'revisit', canonical_url, page_id * 2 + 1001, h, nth, NULL FROM mark),
w AS (SELECT record_id, kind, canonical_url, t, h, nth, html, last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY t, record_id, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM rec),
j AS (SELECT w.*, m.own AS s_own, m.h AS s_h, m.nth AS s_nth, m.html AS s_html, n.own FROM w LEFT JOIN mark m ON m.page_id = w.r AND w.kind = 'revisit' AND w.canonical_url IS NOT NULL JOIN mark n ON n.page_id = w.record_id),
s AS (SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN canonical_url IS NULL THEN 'no_url' WHEN s_h IS NULL THEN 'no_earlier' WHEN CASE WHEN nth = 3 THEN s_nth = 3 AND h = s_h ELSE own IS NOT DISTINCT FROM s_own END THEN 'resolved' ELSE 'validator_mismatch' END AS state FROM j),
o AS (SELECT *, CASE WHEN state = 'full' THEN list_filter(['content-type:text/html', 'content-length:' || strlen(coalesce(html, '')), 'cache-control:max-age=60', 'server:a', own], lambda x: x IS NOT NULL)
  WHEN state = 'resolved' THEN list_filter(['content-type:text/html', 'content-length:' || strlen(coalesce(s_html, '')), 'server:a', 'cache-control:max-age=600', 'x-cache:hit', CASE WHEN own IS NULL THEN s_own WHEN nth = 2 THEN replace(own, 'etag:', 'etag:W/') ELSE own END], lambda x: x IS NOT NULL)
  ELSE list_filter(['content-length:0', 'cache-control:max-age=600', 'connection:close, X-Hop', 'x-hop:1', 'x-cache:hit', CASE WHEN nth = 2 THEN replace(own, 'etag:', 'etag:W/') ELSE own END], lambda x: x IS NOT NULL) END AS lines, coalesce(CASE WHEN state = 'full' THEN html WHEN state = 'resolved' THEN s_html END, '') AS body FROM s)
SELECT record_id, kind, canonical_url, state, CASE WHEN state = 'resolved' THEN r END AS response_id, CAST(CASE WHEN state IN ('full', 'resolved') THEN 200 ELSE 304 END AS BIGINT) AS status, sha256(array_to_string(list_sort(lines), chr(10))) AS headers_sha256, CAST(length(body) AS BIGINT) AS n_chars, sha256(body) AS body_sha256 FROM o
"""

_PHRASE = " OR ".join(f"contains(folded, '{p}')" for p in _BOILERPLATE)

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, {_WORDS}), []) AS w FROM documents),
tri AS (SELECT doc_id, s, w[s : s + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS pos FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS c FROM tri) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, line, regexp_extract_all(line, {_WORDS}) AS w, {_AZ.format('line')} AS folded FROM l),
lf AS (SELECT doc_id, line, w, len(w) AS size, folded, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper,
  len(list_filter(w, lambda x: x IN ('|', '>', '>>', '»', '•', '·', '/'))) AS seps, len(list_filter(w, lambda x: x[-1] IN ('.', '!', '?'))) AS stops, w[-1][-1] AS last FROM lw WHERE len(w) > 0),
j AS (SELECT doc_id, size, line, (size >= 8 AND NOT (last IN ('.', '!', '?', ':', ';', ',', '"', '''', ')', ']', '}}', '-') OR ord(last) > 127) AND stops = 0) OR sym >= greatest(1, 0.1 * size) OR (letters >= 12 AND upper > 0.7 * letters) OR (seps >= 2 AND seps >= 0.25 * size) OR (size <= 20 AND ({_PHRASE})) AS fails FROM lf),
a AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines, count(*) FILTER (fails) AS n_failed_lines, coalesce(sum(size) FILTER (fails), 0) AS n_lost_words FROM j GROUP BY doc_id),
o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words FROM d LEFT JOIN a USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND n_lost_words <= 0.5 * n_words AS kept FROM b
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_AZ.format('text')}, {_WORDS}), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x AS doc_id, x AS r FROM both_ways UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r), d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n
"""

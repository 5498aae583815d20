"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_OP1 = r"""
WITH RECURSIVE rules(rule, verdict) AS (
  VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')
), page AS (
  SELECT page_id, url, html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), tags AS (
  SELECT url, host, path, regexp_extract(tag, CASE kind WHEN 'link'
           THEN '(?i)^<link\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)'
           ELSE '(?i)^<meta\b[^>]*?\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*''?([^"''\s>]+)' END, 1) AS found,
         kind, pos, id
  FROM (
    SELECT id, url, host, path, 'link' AS kind, unnest(all_links) AS tag, generate_subscripts(all_links, 1) AS pos
    FROM (SELECT row_number() OVER () AS id, url, host, path,
                 regexp_extract_all(html, '(?i)<link\b[^>]*') AS all_links FROM page)
    UNION ALL
    SELECT id, url, host, path, 'meta' AS kind, unnest(all_metas) AS tag, generate_subscripts(all_metas, 1) AS pos
    FROM (SELECT row_number() OVER () AS id, url, host, path,
                 regexp_extract_all(html, '(?i)<meta\b[^>]*') AS all_metas FROM page)
  )
  WHERE regexp_matches(tag, CASE kind WHEN 'link' THEN '(?i)\brel\s*=\s*["'']?canonical\b'
                                      ELSE '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b' END)
), named AS (
  SELECT url, host, path, replace(arg_min(found, pos), '&amp;', '&') AS target
  FROM tags WHERE found <> '' GROUP BY id, kind, url, host, path
), parted AS (
  SELECT *, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme,
         regexp_extract(target, '(?s)^([^?#]*)', 1) AS own,
         regexp_extract(target, '(?s)^[^?#]*(.*)$', 1) AS rest,
         CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/'
              ELSE regexp_replace(path, '[^/]*$', '') END AS folder
  FROM named
), folded AS (
  SELECT *, list_reduce(
    string_split(regexp_replace(CASE WHEN own LIKE '/%' THEN own ELSE folder || own END,
                                '(^|/)(\.\.?)$', '\1\2/'), '/')[2:],
    lambda done, part: CASE part WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done
                       ELSE done || '/' || part END, '') AS whole
  FROM parted
), resolved AS (
  SELECT url, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN target LIKE '//%' THEN scheme || ':' || target
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') OR NOT contains(url, '://') THEN NULL
    WHEN target LIKE '#%' THEN url
    WHEN target LIKE '?%' THEN scheme || '://' || host || path || target
    ELSE scheme || '://' || host || CASE whole WHEN '' THEN '/' ELSE whole END || rest END AS goal
  FROM folded
), urls AS (
  SELECT url FROM page UNION SELECT goal FROM resolved
), nodes AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         || CASE WHEN tail LIKE '/%' THEN tail ELSE '/' || tail END AS node
  FROM (SELECT url, regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS tail FROM urls)
  WHERE contains(url, '://')
), edges AS (
  SELECT a.node AS a, b.node AS b
  FROM resolved r JOIN nodes a ON r.url = a.url JOIN nodes b ON r.goal = b.url WHERE a.node <> b.node
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reached AS (
  SELECT a AS node, a AS other FROM both_ways
  UNION
  SELECT r.node, e.b FROM reached r JOIN both_ways e ON r.other = e.a
), places AS (
  SELECT host, path FROM page
  UNION
  SELECT regexp_extract(node, '(?s)^([^/?#]*)', 1), regexp_extract(node, '(?s)^[^/?#]*([^?#]*)', 1) FROM reached
), ruled AS (
  SELECT p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM places p JOIN rules r
    ON (p.host = split_part(rule, '/', 1) OR ends_with(p.host, '.' || split_part(rule, '/', 1)))
   AND starts_with(p.path, substr(rule, strpos(rule, '/')))
  GROUP BY p.host, p.path
), blocked AS (
  SELECT DISTINCT node FROM reached JOIN ruled
    ON host = regexp_extract(other, '(?s)^([^/?#]*)', 1) AND path = regexp_extract(other, '(?s)^[^/?#]*([^?#]*)', 1)
  WHERE verdict = 'block'
)
SELECT p.page_id, p.host, p.path, r.rule,
       coalesce(r.verdict, CASE WHEN b.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       r.rule IS NULL AND b.node IS NOT NULL AS by_alias
FROM page p LEFT JOIN ruled r ON p.host = r.host AND p.path = r.path
LEFT JOIN nodes n ON p.url = n.url LEFT JOIN blocked b ON n.node = b.node
"""

_OP3 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END) AS shingle
  FROM texts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id,
       d.doc_id = min(r.other) AS kept
FROM documents d JOIN reached r ON d.doc_id = r.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
GROUP BY d.doc_id
"""

_OP4 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, x, CASE WHEN usable THEN list_dot_product(x, x) END AS norm
  FROM (
    SELECT vec_id, list_transform(embedding, lambda c: coalesce(c, 0)::DOUBLE) AS x,
           len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AS usable
    FROM embeddings
  )
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
    ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
  WHERE CASE WHEN len(a.x) = len(b.x) AND a.norm > 0 AND b.norm > 0
             THEN list_dot_product(a.x, b.x) / sqrt(a.norm * b.norm) END >= 0.95
), reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT r.vec_id, coalesce(any_value(c.n), 0)::BIGINT AS n_links, min(r.other) AS component_id,
       r.vec_id = min(r.other) AS kept
FROM reached r LEFT JOIN counts c ON r.vec_id = c.vec_id GROUP BY r.vec_id
"""

_OP5 = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), named AS (
  SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS hexed,
         max(page_id) OVER (PARTITION BY payload) AS original
  FROM payloads
)
SELECT page_id, payload_bytes,
       array_to_string([
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hexed, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)
         for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < original THEN original END AS refers_to
FROM named
"""

_OP7 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), windows AS (
  SELECT nr, unnest(range(1, len(w) - 3)) AS place,
         unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) AS five
  FROM worded WHERE len(w) >= 5
), repeated AS (
  SELECT nr, unnest(range(place, place + 5)) AS place
  FROM (SELECT nr, place, count(*) OVER (PARTITION BY nr, five) AS n FROM windows) WHERE n >= 2
), repeats AS (
  SELECT nr, count(DISTINCT place) AS n FROM repeated GROUP BY nr
), split AS (
  SELECT nr, unnest(string_split(text, chr(10))) AS line FROM texts
), lines AS (
  SELECT nr, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM split
), counted AS (
  SELECT nr, line, len(w) AS n, length(array_to_string(w, '')) AS chars,
         len([x for x in w if regexp_full_match(x, '[|»›·•>/]+')]) AS separators,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols
  FROM lines WHERE len(w) > 0
), judged AS (
  SELECT *, (separators >= 3 AND n - separators <= 3 * (separators + 1))
    OR (n <= 25 AND (regexp_matches(line, '(?i)\b((enable|requires?|turn on) javascript|uses? cookies|cookie (policy|settings)|privacy policy|terms of (use|service)|all rights reserved|subscribe to (our|the) newsletter|sign up for (our|the))\b')
      OR regexp_matches(line, '(?i)^[\x20\x09-\x0D]*(log ?in|sign in|sign up|read more|share this|skip to content|back to top)[^A-Za-z0-9_]*$')))
    OR (n >= 16 AND NOT regexp_matches(line, '[.!?,;:…。！？、，；：؟،۔।]'))
    OR (n >= 4 AND 4 * symbols > n) AS fails
  FROM counted
), per_text AS (
  SELECT nr, count(*) - count(DISTINCT line) AS dups, count(*) FILTER (WHERE fails) AS failed,
         coalesce(sum(chars) FILTER (WHERE fails), 0)::BIGINT AS lost
  FROM judged GROUP BY nr
), base AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, length(array_to_string(d.w, ''))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(p.dups, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         coalesce(p.failed, 0)::BIGINT AS n_lines_failed, coalesce(p.lost, 0)::BIGINT AS lost_chars
  FROM worded d LEFT JOIN per_text p ON d.nr = p.nr LEFT JOIN repeats r ON d.nr = r.nr
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost_chars <= word_chars AS kept,
       n_lines_failed, lost_chars
FROM base
"""

_OP10 = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), held AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.line, k.pos, h.key IS NOT NULL AND k.doc_id <> h.first_id AS gone
  FROM keyed k LEFT JOIN held h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP12 = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

_OP13 = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), sizes AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM doc_terms GROUP BY doc_id
), totals AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes
), held AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM doc_terms GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, totals GROUP BY term
), parts AS (
  SELECT item_id, doc_id,
         w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))) AS part
  FROM item_terms JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals
), scored AS (
  SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank,
       doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": _OP1,
    "op3_minhash": _OP3,
    "op4_nn_descent": _OP4,
    "op5_warc_revisits": _OP5,
    "op7_line_quality": _OP7,
    "op10_line_dedup": _OP10,
    "op12_chunk_recipes": _OP12,
    "op13_ranked_search": _OP13,
}

"""DuckDB SQL of the queries that SQL can express.

Left out: license scan, resharding, training order and packing, which need alignment, a flow, a
permutation or a tokenizer, and the nearest vectors, which are approximate. Tests hold these against
plain versions instead.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BARE = r"regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g')"

_QUALITY = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents
), places AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5),
grams AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM places),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams) WHERE n > 1),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
base AS (
  SELECT w.rid, doc_id, lang, source, len(ws) AS n_words, length({_BARE.format('text')}) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: length({_BARE.format('x')}) > 0) AS lines,
    coalesce(again.n, 0) AS n_repeat_words
  FROM w LEFT JOIN again ON w.rid = again.rid
), measured AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    word_chars::DOUBLE / greatest(n_words, 1) AS word_length,
    n_symbols::DOUBLE / greatest(word_chars, 1) AS symbol_share,
    (len(lines) - len(list_distinct(lines)))::DOUBLE / greatest(len(lines), 1) AS dup_line_share
  FROM base
), rates AS (
  SELECT lang, source, 'word_length' AS rate, word_length AS v FROM measured WHERE n_words > 0
  UNION ALL SELECT lang, source, 'symbol_share', symbol_share FROM measured WHERE n_words > 0
  UNION ALL SELECT lang, source, 'dup_line_share', dup_line_share FROM measured WHERE n_words > 0
), sketch AS (
  SELECT lang, source, rate,
    CASE WHEN v <= 0 THEN -1000000 ELSE ceil(ln(v) / ln(1.01::DOUBLE / 0.99::DOUBLE))::BIGINT END AS b, count(*) AS n
  FROM rates GROUP BY ALL
), levels AS (
  SELECT 1 AS level, lang, source, rate, b, n FROM sketch
  UNION ALL SELECT 2, lang, NULL, rate, b, sum(n) FROM sketch GROUP BY lang, rate, b
  UNION ALL SELECT 3, NULL, NULL, rate, b, sum(n) FROM sketch GROUP BY rate, b
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY b) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM levels
), valued AS (
  SELECT *, CASE WHEN b = -1000000 THEN 0.0::DOUBLE
    ELSE 2 * pow(1.01::DOUBLE / 0.99::DOUBLE, b) / (1.01::DOUBLE / 0.99::DOUBLE + 1) END AS v FROM ranked
), quartiles AS (
  SELECT level, lang, source, rate, max(total) AS total,
    min(CASE WHEN upto > 0.25 * (total - 1) THEN v END) AS low,
    min(CASE WHEN upto > 0.75 * (total - 1) THEN v END) AS high
  FROM valued GROUP BY level, lang, source, rate
), picked AS (
  SELECT a.lang, a.source, a.rate,
    CASE WHEN a.total >= 100 THEN a.low WHEN b.total >= 100 THEN b.low ELSE c.low END AS low,
    CASE WHEN a.total >= 100 THEN a.high WHEN b.total >= 100 THEN b.high ELSE c.high END AS high
  FROM (FROM quartiles WHERE level = 1) a
  JOIN (FROM quartiles WHERE level = 2) b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rate = b.rate
  JOIN (FROM quartiles WHERE level = 3) c ON a.rate = c.rate
), f AS (
  SELECT lang, source,
    max(CASE WHEN rate = 'word_length' THEN low END) AS wl, max(CASE WHEN rate = 'word_length' THEN high END) AS wh,
    max(CASE WHEN rate = 'symbol_share' THEN low END) AS sl, max(CASE WHEN rate = 'symbol_share' THEN high END) AS sh,
    max(CASE WHEN rate = 'dup_line_share' THEN low END) AS dl, max(CASE WHEN rate = 'dup_line_share' THEN high END) AS dh
  FROM picked GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed
    AND word_length <= wh + 6.0 * greatest(wh - wl, 0.4::DOUBLE) * (1 + sqrt(20.0 / greatest(n_words, 1)))
    AND word_length >= wl - 6.0 * greatest(wh - wl, 0.4::DOUBLE) * (1 + sqrt(20.0 / greatest(n_words, 1)))
    AND symbol_share <= sh + 6.0 * greatest(sh - sl, 0.005::DOUBLE)
    AND dup_line_share <= dh + 6.0 * greatest(dh - dl, 0.08::DOUBLE), false) AS kept
FROM measured m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""

_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len({_WORDS}) AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS tie FROM documents
), keyed AS (
  SELECT *, -ln((('0x' || substr(tie, 1, 13))::BIGINT::DOUBLE + 1.0) / (pow(2::DOUBLE, 52) + 1.0))
    / (1.0::DOUBLE / (1.0 + 20.0::DOUBLE * length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) / (length(text) + 1.0::DOUBLE))) AS k
  FROM d
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), l AS (
  SELECT *, 2.0 * source_size::DOUBLE AS most, 2.0 * source_size::DOUBLE / weight AS ratio FROM r
), v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM l WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, ratio) FROM v WHERE level <= ratio) * weight, most)) AS target
  FROM v
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS epochs FROM t
), run AS (
  SELECT doc_id, size, keyed.source, source_size, target, epochs,
    CASE WHEN source_size > 0 THEN target - epochs * source_size ELSE 0 END AS budget,
    sum(size) OVER (PARTITION BY keyed.source ORDER BY k, tie ROWS UNBOUNDED PRECEDING) - size AS begin
  FROM keyed JOIN e ON keyed.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN begin + size / 2 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""

_SUFFIX = rf"""
WITH d AS (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS key, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, key, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
g AS (SELECT doc_id, key, i, md5(array_to_string(ws[i:i + 49], ' ')) AS gram FROM p),
shared AS (
  SELECT gram FROM g GROUP BY gram HAVING min(doc_id) <> max(doc_id) OR min(key) <> max(key)
), places AS (SELECT doc_id, key, i FROM g SEMI JOIN shared USING (gram)),
marked AS (
  SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id, key ORDER BY i) + 50, true)::INT AS new FROM places
), islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, key ORDER BY i) AS island FROM marked)
SELECT doc_id, min(i) - 1 AS start_word, max(i) + 49 AS end_word, max(i) + 50 - min(i) AS n_words
FROM islands GROUP BY doc_id, key, island
"""

_LINES = rf"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    list_filter(string_split(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
        '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', chr(10), 'g'),
        '(?i)</?(?:a|b|i|u|em|strong|span|small|sup|sub|code)(?:>|\s[^>]*(?:>|\z))', '', 'g'), '<[A-Za-z/!?][^>]*(?:>|\z)', chr(10), 'g'),
      chr(10)), lambda x: length({_BARE.format('x')}) > 0) AS lines
  FROM pages
), totals AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
held AS (SELECT DISTINCT rid, host, trim(unnest(lines), {_BLANK}) AS line FROM p),
bad AS (
  SELECT h.host, line FROM (SELECT host, line, count(*) AS n FROM held GROUP BY host, line) h
  JOIN totals t ON h.host IS NOT DISTINCT FROM t.host WHERE n >= 2 AND n > 0.1::DOUBLE * host_pages
), sets AS (SELECT host, list(line) AS bad FROM bad GROUP BY host),
kept AS (
  SELECT page_id, p.host, host_pages, lines,
    list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), trim(x, {_BLANK}))) AS left_lines
  FROM p JOIN totals t ON p.host IS NOT DISTINCT FROM t.host LEFT JOIN sets s ON p.host IS NOT DISTINCT FROM s.host
)
SELECT page_id, host, host_pages, len(lines) AS n_lines, len(left_lines) AS n_kept,
  md5(coalesce(array_to_string(left_lines, chr(10)), '')) AS kept_md5
FROM kept
"""

_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, md5(coalesce(text, '')) AS key, {_WORDS} AS ws FROM documents),
t AS (SELECT key, any_value(ws) AS ws, count(*) AS copies, min(doc_id) AS lowest FROM d WHERE len(ws) > 0 GROUP BY key),
p AS (SELECT key, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM t),
g AS (SELECT DISTINCT key, array_to_string(ws[i:i + 4], ' ') AS gram FROM p),
n AS (SELECT key, count(*) AS n FROM g GROUP BY key),
common AS (SELECT a.key AS a, b.key AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.key <> b.key GROUP BY ALL),
e AS (
  SELECT a, b FROM common JOIN n x ON a = x.key JOIN n y ON b = y.key WHERE 5 * c >= 4 * (x.n + y.n - c)
), reach AS (SELECT key AS a, key AS b FROM t UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
classes AS (SELECT a AS key, min(lowest) AS class_id FROM reach JOIN t ON b = t.key GROUP BY a),
links AS (SELECT a AS key, sum(copies) AS n FROM e JOIN t ON b = t.key GROUP BY a)
SELECT doc_id, CASE WHEN len(d.ws) > 0 THEN class_id ELSE doc_id END AS class_id,
  CASE WHEN len(d.ws) > 0 THEN coalesce(l.n, 0) + t.copies - 1 ELSE 0 END::BIGINT AS n_links
FROM d LEFT JOIN t ON d.key = t.key LEFT JOIN classes c ON d.key = c.key LEFT JOIN links l ON d.key = l.key
"""

_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), t AS (
  SELECT rid, lang, source, translate(
    unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'
  ) AS term FROM d
), k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
vocab AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + v.v) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN vocab v ON g.lang = v.lang
  LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 1)) // (sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT + any_value(v.v)) AS q
  FROM c JOIN vocab v USING (lang) GROUP BY lang, term
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""

# Places 1 to 9 of each step list are a byte and eight shifts of the checksum's register.
_TRIE = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, n, conv_id - conv_id % 20 AS base,
    xor(list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END
    ), 4294967295) % 4 AS h
  FROM o
), c AS (
  SELECT i.*, least(i.h, coalesce(b.n, 0)) AS m FROM ids i LEFT JOIN ids b ON i.base = b.conv_id
), r AS (
  SELECT c.conv_id, o.pos AS depth, role, text FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.m
  UNION ALL SELECT c.conv_id, o.pos - c.h + c.m, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h
), said AS (
  SELECT conv_id, depth, text, md5(length(role) || ':' || role || text) AS t FROM r
), path AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node
  FROM said
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max_by(node, depth) AS node FROM path GROUP BY conv_id) GROUP BY node
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved FROM path GROUP BY node, depth
), children AS (
  SELECT left(node, length(node) - 32) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children ON nodes.node = children.node
), sums AS (
  SELECT path.node, sum(f.saved) AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves
  FROM full_nodes f JOIN path ON path.conv_id = f.conv_id AND path.depth <= f.depth GROUP BY path.node
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, sums.n_leaves,
  sums.saved_tokens::BIGINT AS saved_tokens, coalesce(ends.ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes f JOIN sums ON f.node = sums.node LEFT JOIN ends ON f.node = ends.node
LEFT JOIN nodes p ON f.depth > 0 AND p.node = left(f.node, length(f.node) - 32)
"""

ORACLES = {
    "op3_quality_rules": _QUALITY,
    "op4_mix_sources": _MIX,
    "op5_suffix_dedup": _SUFFIX,
    "op7_line_dedup": _LINES,
    "op9_jaccard_join": _JACCARD,
    "op11_source_divergence": _DIVERGENCE,
    "op12_prefix_trie": _TRIE,
}

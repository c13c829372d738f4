"""SQL of the operators' queries for DuckDB, written from the rules rather than from the DataFrame code."""

from __future__ import annotations

from .quality_rules import COMMON_WORDS, QualityRules

_RULES = QualityRules()
_LANGS = ", ".join(f"'{x}'" for x in COMMON_WORDS)
_WORDS = ", ".join(f"'{w}'" for words in COMMON_WORDS.values() for w in words)
_SPACE = r"\x20\x09-\x0D"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({_LANGS}) THEN lang ELSE 'other' END AS lang,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[{_SPACE}]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
dup AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN dup USING (doc_id, g), unnest(range(5)) AS o(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
ln AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, l, count(*) AS c FROM lines WHERE regexp_matches(l, '[^{_SPACE}]') GROUP BY doc_id, l) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
cls AS (
  SELECT doc_id, lang, unnest([1, 2, 3, 4, 5, 6]) AS bin, unnest([
      length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^{_SPACE}]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')),
      length(regexp_replace(t, '[\x00-\x7F]', '', 'g')), length(regexp_replace(t, '[^0-9]', '', 'g')), length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g'))]) AS n
  FROM d),
chars AS (
  SELECT 'c' AS kind, doc_id, lang, bin, n FROM cls
  UNION ALL SELECT 'c', d.doc_id, d.lang, 7, length(any_value(d.t)) - sum(cls.n) FROM d JOIN cls USING (doc_id) GROUP BY d.doc_id, d.lang),
listed AS (SELECT unnest([{_WORDS}]) AS word, unnest(range(1, {sum(map(len, COMMON_WORDS.values())) + 1})) AS bin),
seen AS (SELECT doc_id, lang, coalesce(bin, 0) AS bin, count(*) AS n FROM (SELECT doc_id, lang, lower(unnest(w)) AS word FROM d) LEFT JOIN listed USING (word) GROUP BY ALL),
bins AS (SELECT * FROM chars UNION ALL SELECT 'w', doc_id, lang, bin, n FROM seen),
refs AS (SELECT kind, lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY kind, lang) AS q FROM bins GROUP BY kind, lang, bin),
usable AS (SELECT lang FROM refs GROUP BY lang HAVING count(DISTINCT CASE WHEN NOT isnan(q) THEN kind END) = 2),
space AS (SELECT DISTINCT kind, bin FROM (SELECT kind, bin FROM refs UNION ALL SELECT 'c', unnest(range(1, 8)))),
own AS (SELECT kind, doc_id, bin, n::DOUBLE / nullif(sum(n) OVER (PARTITION BY kind, doc_id), 0) AS p FROM bins),
full_bins AS (
  SELECT kind, doc_id, usable.lang, bin, coalesce(p, 0) AS p, coalesce(q, 0) AS q
  FROM d CROSS JOIN usable CROSS JOIN space LEFT JOIN own USING (kind, doc_id, bin) LEFT JOIN refs ON refs.kind = space.kind AND refs.bin = space.bin AND refs.lang = usable.lang),
dist AS (
  SELECT kind, doc_id, lang, CASE WHEN sum(p) > 0 THEN sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) ELSE 0 END AS js
  FROM full_bins GROUP BY kind, doc_id, lang),
near AS (
  SELECT doc_id, bool_or(ok) AS near FROM (
    SELECT doc_id, lang, bool_and(js <= CASE WHEN kind = 'c' THEN CASE WHEN word_chars >= {_RULES.min_chars} THEN {_RULES.char_limit} ELSE 1e9 END
                                             ELSE CASE WHEN n_words >= {_RULES.min_words} THEN {_RULES.word_limit} ELSE 1e9 END END) AS ok
    FROM dist JOIN base USING (doc_id) GROUP BY doc_id, lang) GROUP BY doc_id),
judged AS (SELECT *, n_words < {_RULES.base_words} OR 100 * n_repeat_words > {_RULES.base_repeat_percent} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(near, true) AS kept
FROM judged LEFT JOIN near USING (doc_id)
"""

OP4 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN o USING (key) GROUP BY doc_id
"""

OP6 = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rule, h, p0, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p0) GROUP BY page_id),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), '\.$', '') || regexp_replace(path, '/$', '') AS url FROM p),
bad AS (
  SELECT label || '.example.' || top || '/' || lang || '/' || n AS url
  FROM unnest(['spam-farm', 'cheap-pills', 'casino-win', 'free-bets']) AS a(label), unnest(['com', 'net', 'org']) AS b(top), unnest(['de', 'en', 'es', 'fr']) AS l(lang), range(2000) AS r(n))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit USING (page_id) LEFT JOIN bad ON c.url = bad.url
"""

OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS r(n)),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 12 + 10 + 10 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x1c-\x1f\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE c / (p.n + q.n - c) >= 0.8),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT x AS doc_id, min(y) AS class_id, (SELECT count(*) FROM l WHERE l.x = r.x) AS n_links FROM r GROUP BY x
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS r(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, ks, unnest(range(1, len(w) - k + 2)) AS r(i)),
hit AS (SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, s)),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT DISTINCT doc_id, k, i FROM hit), unnest(range(k)) AS r(o) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

#: A byte's CRC-32 by its reflected polynomial, and that of a list of bytes.
_TAB = "tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"


def _crc(listed: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {listed}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


OP11 = rf"""
WITH {_TAB},
x AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', NULL, row_number() OVER (), text FROM benchmark),
w AS (SELECT side, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM x),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)),
b AS (SELECT word, {_crc("list_transform(range(1, length(h), 2), lambda k: ('0x' || substr(h, k, 2))::BIGINT)")} % 10000 AS bucket FROM v, tab),
n AS (SELECT side, r, bucket FROM w JOIN b USING (word)),
c AS (SELECT i AS bucket, count(side) FILTER (WHERE side = 'd') AS s, count(side) FILTER (WHERE side = 'b') AS t FROM range(10000) AS q(i) LEFT JOIN n ON bucket = i GROUP BY i),
g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
m AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE side = 'd' GROUP BY r),
y AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM x LEFT JOIN m USING (r) WHERE side = 'd'),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * able // 100 THEN k END AS rank FROM z
"""

OP13 = f"""
WITH {_TAB},
p AS (SELECT sale_id, floor(epoch(sold_at) / 86400)::BIGINT AS slot, floor(floor(100 * total + 0.5::DOUBLE) / 1000)::BIGINT AS level,
        1 + coalesce({_crc("list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 3, 0) AS stands_for FROM sales, tab),
c AS (SELECT slot, level, count(*) AS n, sum(stands_for) AS m FROM p WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
a AS (SELECT x.slot, x.level, coalesce(sum(y.n), 0)::BIGINT AS n_sales, coalesce(sum(y.m), 0)::BIGINT AS n_rows FROM c AS x LEFT JOIN c AS y ON y.slot <= x.slot AND y.level > x.level GROUP BY x.slot, x.level)
SELECT sale_id, slot, level, n_sales, n_rows FROM p LEFT JOIN a USING (slot, level)
"""

"""DuckDB SQL for the corpus queries that SQL can express, on the driver's tables."""

from __future__ import annotations

_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w),
g AS (SELECT doc_id, place, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN concat_ws(chr(1), word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS gram FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
twice AS (SELECT doc_id, place, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS dup FROM g),
covered AS (SELECT doc_id, max(dup::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM twice),
r AS (SELECT doc_id, sum(hit) AS n_repeat_words FROM covered GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) AS x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d JOIN w USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
m AS (SELECT doc_id, lang, source, unnest([
  {'measure': 'symbols', 'width': 100, 'v': CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END}, {'measure': 'capitals', 'width': 150, 'v': CASE WHEN word_chars > 0 THEN n_capitals * 1000 // word_chars ELSE 0 END},
  {'measure': 'dup_lines', 'width': 300, 'v': CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END}, {'measure': 'word_length', 'width': 400, 'v': CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END}], recursive := true) FROM c),
b AS (SELECT *, v - v % CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT) AS bucket FROM m),
s AS (SELECT lang, source, measure, width, bucket, count(*) AS n FROM b GROUP BY ALL),
fine AS (SELECT lang, source, measure, width, min(bucket) FILTER (WHERE upto * 100 >= total * 50) AS q50, min(bucket) FILTER (WHERE upto * 100 >= total * 75) AS q75, max(total) AS n_rows FROM
  (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM s) AS x GROUP BY ALL),
by_lang AS (SELECT lang, measure, min(bucket) FILTER (WHERE upto * 100 >= total * 50) AS q50, min(bucket) FILTER (WHERE upto * 100 >= total * 75) AS q75, max(total) AS n_rows FROM
  (SELECT *, sum(n) OVER (PARTITION BY lang, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, measure) AS total FROM (SELECT lang, measure, bucket, sum(n) AS n FROM s GROUP BY ALL) AS y) AS x GROUP BY ALL),
overall AS (SELECT measure, min(bucket) FILTER (WHERE upto * 100 >= total * 50) AS q50, min(bucket) FILTER (WHERE upto * 100 >= total * 75) AS q75 FROM
  (SELECT *, sum(n) OVER (PARTITION BY measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY measure) AS total FROM (SELECT measure, bucket, sum(n) AS n FROM s GROUP BY ALL) AS y) AS x GROUP BY ALL),
fence AS (SELECT f.lang, f.source, f.measure, CASE WHEN f.n_rows >= 50 THEN f.q50 + greatest(f.width, 6 * (f.q75 - f.q50)) WHEN g.n_rows >= 50 THEN g.q50 + greatest(f.width, 6 * (g.q75 - g.q50)) ELSE o.q50 + greatest(f.width, 6 * (o.q75 - o.q50)) END AS most
  FROM fine f JOIN by_lang g USING (lang, measure) JOIN overall o USING (measure)),
beyond AS (SELECT doc_id, bool_or(v > most) AS out FROM m JOIN fence USING (lang, source, measure) GROUP BY doc_id),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c JOIN beyond USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT out AS kept FROM j"""

_URLS = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (SELECT page_id, rule, verdict FROM (SELECT page_id, concat(rhost, rpath) AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(concat(rhost, rpath)) DESC) AS place FROM u JOIN rules
  ON (host = rhost OR ends_with(host, concat('.', rhost))) AND starts_with(path, rpath)) AS x WHERE place = 1),
h AS (SELECT host, count(1 - quality) FILTER (WHERE host <> '') AS n, coalesce(sum(1 - quality) FILTER (WHERE host <> ''), 0) AS bad FROM u LEFT JOIN labels ON page_id = labels.doc_id GROUP BY host),
s AS (SELECT *, string_split(host, '.') AS p, list_contains(['ac.uk', 'co.in', 'co.jp', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'com.mx', 'gov.uk', 'net.au', 'org.au', 'org.uk'], regexp_extract(host, '([^.]*\.[^.]*)$', 1)) AS two FROM h),
t AS (SELECT host, n, bad, CASE WHEN two THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix, CASE WHEN two AND len(p) >= 3 THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM s),
dom AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM t GROUP BY ALL),
suf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dom GROUP BY ALL),
alls AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS prior FROM suf),
s1 AS (SELECT *, prior AS m FROM suf, alls),
k1 AS (SELECT sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m)) AS between_, sum(m * (1 - m) * (n - 1)) AS room FROM s1 WHERE n > 1),
f1 AS (SELECT least(greatest(CASE WHEN room > 0 AND between_ > 0 THEN room / between_ - 1 ELSE 1000 END, 2), 1000) AS k FROM k1),
top AS (SELECT suffix, (k * m + bad) / (k + n) AS prior FROM s1, f1),
s2 AS (SELECT dom.*, prior AS m FROM dom JOIN top USING (suffix)),
k2 AS (SELECT sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m)) AS between_, sum(m * (1 - m) * (n - 1)) AS room FROM s2 WHERE n > 1),
f2 AS (SELECT least(greatest(CASE WHEN room > 0 AND between_ > 0 THEN room / between_ - 1 ELSE 1000 END, 2), 1000) AS k FROM k2),
mid AS (SELECT domain, (k * m + bad) / (k + n) AS prior FROM s2, f2),
s3 AS (SELECT t.*, prior AS m FROM t JOIN mid USING (domain)),
k3 AS (SELECT sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m)) AS between_, sum(m * (1 - m) * (n - 1)) AS room FROM s3 WHERE n > 1),
f3 AS (SELECT least(greatest(CASE WHEN room > 0 AND between_ > 0 THEN room / between_ - 1 ELSE 1000 END, 2), 1000) AS k FROM k3),
low AS (SELECT host, (k * m + bad) / (k + n) AS mean, k + n AS weight FROM s3, f3),
bound AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5 AS blocked FROM low)
SELECT u.page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN 'reputation' ELSE 'rule' END AS reason
FROM u LEFT JOIN fit USING (page_id) LEFT JOIN bound USING (host)"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + "))"

_MERKLE = rf"""
WITH RECURSIVE crcs AS (SELECT doc_id, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS rest FROM documents),
l AS (SELECT doc_id, source, {_LEAF} AS leaf FROM documents),
t AS (SELECT doc_id, {_LEAF} AS presented FROM (SELECT doc_id, source, lang, n_chars, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents) AS lowered SEMI JOIN (SELECT doc_id FROM crcs WHERE xor(rest, 4294967295) % 5 = 0) AS c USING (doc_id)),
n AS (SELECT doc_id, leaf, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size FROM l),
node(tree, lev, idx, size, h) AS (SELECT tree, 0, idx, size, leaf FROM n
  UNION ALL SELECT tree, lev + 1, idx // 16, (max(size) + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE size > 1 GROUP BY tree, lev, idx // 16),
subroot AS (SELECT tree, h, lev FROM node WHERE size = 1),
top(lev, idx, size, h) AS (SELECT 0, tree, count(*) OVER (), h FROM subroot
  UNION ALL SELECT lev + 1, idx // 16, (max(size) + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE size > 1 GROUP BY lev, idx // 16),
every AS (SELECT tree, lev, idx, h, size FROM node WHERE size > 1 UNION ALL SELECT -1, lev, idx, h, size FROM top WHERE size > 1),
step AS (SELECT a.tree, a.lev, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS lefts, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS rights
  FROM every a JOIN every b ON a.tree = b.tree AND a.lev = b.lev AND a.idx // 16 = b.idx // 16 GROUP BY ALL),
walk AS (SELECT n.doc_id, s.lev AS place, s.lefts, s.rights FROM n JOIN step s ON s.tree = n.tree AND s.idx = n.idx // CAST(pow(16, s.lev) AS BIGINT)
  UNION ALL SELECT n.doc_id, 100 + s.lev, s.lefts, s.rights FROM n JOIN step s ON s.tree = -1 AND s.idx = n.tree // CAST(pow(16, s.lev) AS BIGINT)),
proof AS (SELECT doc_id, sha256(string_agg(lefts || rights, '' ORDER BY place)) AS proof_sha256, list({{'l': lefts, 'r': rights}} ORDER BY place) AS path FROM walk GROUP BY doc_id),
whole AS (SELECT n.doc_id, n.leaf, s.h AS subroot, (SELECT h FROM top WHERE size = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, coalesce(presented, n.leaf) AS begin_, coalesce(path, []) AS path FROM n JOIN subroot s USING (tree) LEFT JOIN proof USING (doc_id) LEFT JOIN t USING (doc_id)),
fold(doc_id, k, h) AS (SELECT doc_id, 0, begin_ FROM whole UNION ALL SELECT f.doc_id, k + 1, sha256(concat(path[k + 1].l, h, path[k + 1].r)) FROM fold f JOIN whole w USING (doc_id) WHERE k < len(path)),
final AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM fold GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM whole JOIN final USING (doc_id)"""

_FILTERS = r"""
WITH told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(ws) < 50, 100 * list_unique(ws) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails FROM w LEFT JOIN told USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, i AS step, o[i] AS own FROM p, x),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE NOT early AND NOT fails[own]) AS kept, sum(n) FILTER (WHERE NOT early AND fails[own]) AS removed, sum(n) FILTER (WHERE early AND fails[own]) AS redundant,
  sum(n) FILTER (WHERE fails[own] AND len(list_filter(fails, lambda y: y)) = 1) AS unique_fails, sum(good) FILTER (WHERE NOT early AND fails[own]) AS good_lost, sum(toxic) FILTER (WHERE NOT early AND fails[own]) AS toxic_lost
  FROM (SELECT *, len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS early FROM c, s) AS y GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""

_ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), g AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, strlen(p.html) AS payload_bytes, sha256(p.html) AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM p LEFT JOIN g USING (html)"""

ORACLES: dict[str, str] = {"op4_quality_rules": _QUALITY, "op6_url_filters": _URLS, "op11_merkle_manifest": _MERKLE, "op12_filter_audit": _FILTERS, "op13_warc": _ARCHIVES}

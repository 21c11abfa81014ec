"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT u.page_id, u.host, u.path,
  max_by(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(max_by(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
GROUP BY u.page_id, u.host, u.path
"""

_METRICS = r"""
d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, range(5) k(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(list_aggregate(list_concat([''], ws), 'string_agg', ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w) w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::BIGINT) AS f FROM b GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum((f / n) * (f / n) * n) AS q, sum(f) / sum(n) AS mean FROM h),
p AS (SELECT mean, CASE WHEN (greatest(0.0, q - n * mean * mean) - (k - 1) * mean * (1 - mean)) / n > 0
        THEN least(greatest(mean * (1 - mean) / ((greatest(0.0, q - n * mean * mean) - (k - 1) * mean * (1 - mean)) / n) - 1, 1.0), 1000.0) ELSE 1000.0 END AS strength FROM s),
judged AS (SELECT b.*, NOT base_failed AND (h.f + mean * strength) / (h.n + strength) <= 0.5 AS kept
  FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source, p)
"""

OP4 = f"WITH {_METRICS} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"

_SIZED = r"""
z AS (SELECT doc_id, source, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents)
"""

# Five rounds of filling settle any three-weight mix: from the second on, a source above its cap stays there.
OP7 = rf"""
WITH RECURSIVE {_SIZED},
src AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight FROM z GROUP BY source),
lv(i, level) AS (
  SELECT 0, 1.5 * sum(source_size) / sum(weight) FROM src
  UNION ALL
  SELECT i + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(2.0 * source_size) FILTER (weight * lv.level >= 2.0 * source_size), 0)) / sum(weight) FILTER (weight * lv.level < 2.0 * source_size) FROM src)
  FROM lv WHERE i < 24),
t AS (SELECT source, source_size, CASE WHEN weight * level >= 2.0 * source_size THEN 2.0 * source_size ELSE weight * level END AS target
  FROM src, (SELECT level FROM lv WHERE i = 24)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
x AS (SELECT *, round(target - epochs * source_size)::BIGINT AS extra FROM e),
o AS (SELECT z.doc_id, z.source, z.size, x.source_size, x.target, x.epochs, x.extra,
    coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY md5('mix-1:' || coalesce(z.doc_id::VARCHAR, '')), z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM z JOIN x ON z.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM o
"""

_NEAR = r"""
sw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {docs}),
sh AS (SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM sw WHERE len(ws) >= 5)
    UNION ALL SELECT doc_id, list_aggregate(ws, 'string_agg', ' ') FROM sw WHERE len(ws) BETWEEN 1 AND 4)),
sn AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
lk AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sn p ON p.doc_id = a JOIN sn q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)),
rc(doc_id, c) AS (SELECT doc_id, doc_id FROM {docs} UNION SELECT lk.b, rc.c FROM rc JOIN lk ON lk.a = rc.doc_id WHERE rc.c < lk.b),
nc AS (SELECT doc_id, min(c) AS component_id FROM rc GROUP BY doc_id)
"""

OP10 = f"""WITH RECURSIVE {_NEAR.format(docs="documents")}
SELECT d.doc_id, coalesce(sn.n, 0)::BIGINT AS n_shingles, nc.component_id FROM documents d LEFT JOIN sn USING (doc_id) JOIN nc USING (doc_id)"""

_HITS = r"""
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM {docs}),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
iv AS (SELECT item_id, least(13, len(ws)) AS k, list_aggregate(ws[i:i+least(13, len(ws))-1], 'string_agg', ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM iv),
dv AS (SELECT doc_id, k, i, list_aggregate(ws[i:i+k-1], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
mt AS (SELECT dv.doc_id, dv.k, dv.i, iv.item_id FROM dv JOIN iv ON dv.k = iv.k AND dv.s = iv.s),
hw AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM mt, range(13) r(o) WHERE o < k GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM mt GROUP BY doc_id),
ht AS (SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id))
"""

OP9 = f"WITH {_HITS.format(docs='documents')} SELECT * FROM ht"

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""

OP11 = r"""
WITH pc AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
pw AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pc),
nn AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pw GROUP BY lang),
g AS (SELECT lang, k, ws[i:i+k-1] AS ph FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pw, range(1, 6) r(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY lang, k, ph HAVING count(*) >= 100),
c AS (SELECT lang, k, ph, f AS a FROM f WHERE k > 1),
inside AS (SELECT DISTINCT s.lang, s.ph FROM c s JOIN c b ON s.lang = b.lang AND b.k > s.k AND 100 * b.a >= 100 * s.a
  AND list_contains(list_transform(range(1, b.k - s.k + 2), lambda i: b.ph[i:i+s.k-1]), s.ph)),
cuts AS (SELECT c.lang, c.ph, c.a, j, x.f AS l, y.f AS r, nn.n, ((1000::HUGEINT * c.a * nn.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:j] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[j+1:c.k] JOIN nn ON nn.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
kept AS (SELECT best.lang, list_aggregate(best.ph, 'string_agg', ' ') AS phrase, a, l, r, n, score FROM best ANTI JOIN inside ON inside.lang = best.lang AND inside.ph = best.ph)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

_ENC = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_ENC.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""

OP12 = f"""
WITH RECURSIVE
d AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, CASE WHEN ({_CRC}) % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} END AS altered FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT source FROM d)),
l AS (SELECT o.*, s.tree FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source),
nd(lv, tree, idx, h, n) AS (SELECT 0, tree, idx, leaf, n FROM l
  UNION ALL SELECT lv + 1, tree, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 2) // 3 FROM nd WHERE n > 1 GROUP BY lv, tree, idx // 3),
tp(lv, idx, h, n) AS (SELECT 0, nd.tree, h, trees FROM nd JOIN s ON s.tree = nd.tree WHERE n = 1
  UNION ALL SELECT lv + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 2) // 3 FROM tp WHERE n > 1 GROUP BY lv, idx // 3),
fl(tree, leaf_idx, lv, idx, h, proof) AS (SELECT tree, idx, 0, idx, coalesce(altered, leaf), '' FROM l
  UNION ALL SELECT f.tree, f.leaf_idx, f.lv + 1, f.idx // 3,
    sha256(string_agg(CASE WHEN nd.idx = f.idx THEN f.h ELSE nd.h END, '' ORDER BY nd.idx)), f.proof || coalesce(string_agg(nd.h, '' ORDER BY nd.idx) FILTER (nd.idx <> f.idx), '')
  FROM fl f JOIN nd ON nd.tree = f.tree AND nd.lv = f.lv AND nd.idx // 3 = f.idx // 3 AND nd.n > 1 GROUP BY f.tree, f.leaf_idx, f.lv, f.idx, f.h, f.proof),
sub AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY tree, leaf_idx ORDER BY lv DESC) = 1),
ft(tree, leaf_idx, lv, idx, h, proof) AS (SELECT tree, leaf_idx, 0, tree, h, proof FROM sub
  UNION ALL SELECT f.tree, f.leaf_idx, f.lv + 1, f.idx // 3,
    sha256(string_agg(CASE WHEN tp.idx = f.idx THEN f.h ELSE tp.h END, '' ORDER BY tp.idx)), f.proof || coalesce(string_agg(tp.h, '' ORDER BY tp.idx) FILTER (tp.idx <> f.idx), '')
  FROM ft f JOIN tp ON tp.lv = f.lv AND tp.idx // 3 = f.idx // 3 AND tp.n > 1 GROUP BY f.tree, f.leaf_idx, f.lv, f.idx, f.h, f.proof),
fin AS (SELECT * FROM ft QUALIFY row_number() OVER (PARTITION BY tree, leaf_idx ORDER BY lv DESC) = 1),
rt AS (SELECT h AS root FROM tp WHERE n = 1)
SELECT l.doc_id, l.leaf, nd.h AS subroot, root, sha256(fin.proof) AS proof_sha256, fin.h AS folded_root, fin.h = root AS verified
FROM l JOIN fin ON fin.tree = l.tree AND fin.leaf_idx = l.idx JOIN nd ON nd.tree = l.tree AND nd.n = 1, rt
"""

OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS next FROM t),
e AS (SELECT doc_id, n, text, substr(text, 1, n - n // 2) || substr(next, 1, n // 2) AS edited FROM x),
v AS (SELECT doc_id, 'own' AS what, text FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e),
w AS (SELECT doc_id, what, unnest(list_distinct(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS term FROM v),
lex AS (SELECT term, ('0x' || substr(md5(term), 1, 15))::BIGINT AS num FROM (SELECT term, count(*) AS df FROM w WHERE what = 'own' AND term <> '' GROUP BY term)
  WHERE df * 500 >= (SELECT count(*) FROM t) AND df * 20 <= (SELECT count(*) FROM t)),
pl AS (SELECT k * 7 + b AS place, b, (1 << (2 * (k + 1))) - 1 AS mask FROM range(4) q(k), range(7) r(b)),
h AS (SELECT doc_id, what, place, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS h
  FROM w JOIN lex USING (term) JOIN pl ON (num >> (8 * b)) & mask = 0 GROUP BY doc_id, what, place),
f AS (SELECT v.doc_id, v.what, string_agg(coalesce(h, '--------'), '' ORDER BY place) AS f
  FROM v CROSS JOIN pl LEFT JOIN h USING (doc_id, what, place) GROUP BY v.doc_id, v.what),
a AS (SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, o.f AS fingerprint, d.f AS edited_fingerprint,
    coalesce(lead(o.f) OVER (ORDER BY e.doc_id), first(o.f) OVER (ORDER BY e.doc_id)) AS nf
  FROM e JOIN f o ON o.doc_id = e.doc_id AND o.what = 'own' JOIN f d ON d.doc_id = e.doc_id AND d.what = 'edited'),
p AS (SELECT *, list_transform(range(28), lambda i: substr(fingerprint, 8 * i + 1, 8)) AS fl, list_transform(range(28), lambda i: substr(edited_fingerprint, 8 * i + 1, 8)) AS el,
  list_transform(range(28), lambda i: substr(nf, 8 * i + 1, 8)) AS nl FROM a)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE ELSE len(list_filter(range(1, 29), lambda i: fl[i] = el[i] AND fl[i] <> '--------')) / len(list_filter(range(1, 29), lambda i: fl[i] <> '--------' OR el[i] <> '--------')) END AS near_edited,
  CASE WHEN fingerprint = nf THEN 1.0::DOUBLE ELSE len(list_filter(range(1, 29), lambda i: fl[i] = nl[i] AND fl[i] <> '--------')) / len(list_filter(range(1, 29), lambda i: fl[i] <> '--------' OR nl[i] <> '--------')) END AS near_next
FROM p
"""

ORACLES = {"op13_imatch": OP13, "op12_merkle": OP12, "op11_collocations": OP11, "op6_warc": OP6, "op9_winnow": OP9, "op10_jaccard_join": OP10, "op1_url_filter": OP1, "op4_host_quality": OP4, "op7_mix": OP7}

"""DuckDB SQL that states the queries' results independently, over whole tables."""

from __future__ import annotations

from foliate.llm.licenses import BASE, TEMPLATES

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid),
lines AS (
  SELECT rid, count(l) - count(DISTINCT l) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (
  SELECT d.rid, doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN cov USING (rid)),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters,
         length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS upper_letters,
         len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i - 1]]) AS stutter
  FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 8 * word_chars
            OR word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words
            OR 10 * n_dup_lines > 3 * len(string_split(t, chr(10)))
            OR 2 * upper_letters > letters OR 2 * letters < word_chars
            OR 5 * stutter > n_words) AS kept
FROM b
"""


def _spans(kind: str, order: int, pattern: str, keep: str) -> str:
    """Rows (rid, k, kind, s, e, hit) of one kind; keep: a condition on hit, t and s."""
    return f"""
  SELECT rid, {order} AS k, '{kind}' AS kind, s, s + length(hit) AS e, hit, t FROM (
    SELECT rid, t, m[i] AS hit,
           CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0) AS BIGINT) AS s
    FROM (SELECT rid, t, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT rid, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)))
  WHERE {keep}"""


_D = "d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)"
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_PART = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LUHN = f"""(length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum([
    CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substr({_DIGITS}, i, 1) AS INT)
         WHEN CAST(substr({_DIGITS}, i, 1) AS INT) > 4 THEN 2 * CAST(substr({_DIGITS}, i, 1) AS INT) - 9
         ELSE 2 * CAST(substr({_DIGITS}, i, 1) AS INT) END
    FOR i IN range(1, length({_DIGITS}) + 1)]) % 10 = 0)"""
_IBAN = "replace(hit, ' ', '')"
_REST = f"""list_reduce(list_prepend(0, [CAST(CASE WHEN regexp_matches(c, '[0-9]') THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS INT)
    FOR c IN string_split(substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), '')]),
    lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END)"""

_AGAINST = "example|sample|dummy|version|serial number|part number|order number"

OP5 = f"""
WITH {_D},
s0 AS ({_spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")}
UNION ALL {_spans("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_matches(hit, '^0*{_PART}(\.0*{_PART}){{3}}$')")}
UNION ALL {_spans("card", 2, r"[0-9](?:[\x20-]?[0-9])+", _LUHN)}
UNION ALL {_spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15")}
UNION ALL {_spans("iban", 4, r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", f"length({_IBAN}) BETWEEN 15 AND 34 AND {_REST} = 1")}
UNION ALL {_spans("ssn", 5, "[0-9]{3}-[0-9]{2}-[0-9]{4}", "true")}),
sc AS (SELECT * EXCLUDE (base), base + CASE WHEN regexp_matches(near, pos) THEN 30 ELSE 0 END - CASE WHEN regexp_matches(near, '{_AGAINST}') THEN 30 ELSE 0 END AS score FROM (
  SELECT *, lower(substr(t, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || chr(10) || substr(t, e + 1, 40)) AS near,
    [90, 60, 80, 60, 60, 30][k + 1] AS base, ['mail|contact|write', '\bip\b|address|host|server', 'card|visa|credit|payment', 'phone|call|tel|mobile|fax', 'iban|account|bank', 'ssn|social security|tax id'][k + 1] AS pos FROM s0)),
s AS (SELECT * FROM sc WHERE k < 4 OR score >= 60),
a AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip,
         count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans, string_agg(kind || ':' || s || ':' || score, ',' ORDER BY k, s) AS scores
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(scores, '') AS scores, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""

_ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+"
)
_VALUE = r"^[A-Za-z_]+[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]{8,}$"
_HIGH = """(hit NOT SIMILAR TO '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}'
    AND NOT regexp_matches(hit, '(?i)example|sample|placeholder|dummy|changeme|xxxxx|abcdefgh|01234567')
    AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
    AND list_max([list_aggregate(string_split(substr(hit, i, 24), ''), 'entropy') FOR i IN range(1, length(hit) - 22)])
        >= CASE WHEN regexp_matches(hit, '^[0-9a-f]+$') THEN 3.2 ELSE 4.0 END - 1e-12)"""

OP7 = f"""
WITH {_D},
b AS ({_spans("assign", 0, _ASSIGN, f"regexp_matches(hit, '{_VALUE}')")}
UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "length(hit) >= 16")}
UNION ALL {_spans("hex", 2, "[0-9a-f]{32,}", "true")}),
s AS (SELECT rid, k, kind, s, e FROM b
  UNION ALL SELECT rid, k, kind, s, e FROM ({_spans("entropy", 3, "[A-Za-z0-9+/_-]{24,}", _HIGH)}) AS x
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = x.rid AND b.s < x.e AND x.s < b.e)),
a AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""

OP2 = r"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
st AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY source),
tot AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) FILTER (tokens > 0) AS n FROM st),
g AS (
  SELECT k, sum(pow(tokens / total, k / 4096)) AS z, sum(pow(tokens / total, k / 4096) * ln(tokens / total)) AS s,
         max(pow(tokens / total, k / 4096 - 1)) AS high, max(n) AS n
  FROM st, tot, range(0, 4097) AS x(k) WHERE tokens > 0 GROUP BY k),
a AS (SELECT coalesce(min(k) FILTER (ln(z) - k / 4096 * s / z <= 0.95 * ln(n) + 1e-9 AND high / z <= 2 + 1e-9), 4096) / 4096 AS a FROM g),
raw AS (SELECT source, tokens, total, CASE WHEN tokens > 0 THEN pow(tokens / total, a) ELSE 0 END AS raw FROM st, tot, a),
src AS (
  SELECT source, tokens, CAST(CASE WHEN tokens > 0 THEN floor(raw / (SELECT sum(raw) FROM raw) * total + 1e-6) ELSE 0 END AS BIGINT) AS target FROM raw),
p AS (
  SELECT source, tokens AS all_tokens, CASE WHEN tokens > 0 THEN target // tokens ELSE 1 END AS epochs,
         CASE WHEN tokens > 0 THEN target % tokens ELSE 0 END AS rest, greatest(1, CAST(ceil(tokens / 1048576) AS BIGINT)) AS n_blocks
  FROM src),
d AS (
  SELECT r.doc_id, r.source, r.tokens, epochs, rest,
         CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % n_blocks AS block
  FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source),
k AS (SELECT *, md5('17|block|' || epochs || '|' || block) AS block_key, md5('17|doc|' || epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS doc_key FROM d),
f AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY block_key, doc_key RANGE UNBOUNDED PRECEDING) AS filled FROM k),
c AS (SELECT *, epochs + CASE WHEN rest > 0 AND filled <= rest THEN 1 ELSE 0 END AS copies FROM f)
SELECT doc_id, source, CAST(epoch AS INT) AS epoch, block,
       substr(md5('17|block|' || epoch || '|' || block), 1, 12) || '-' || substr(md5('17|doc|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS order_key
FROM (SELECT *, unnest(range(0, copies)) AS epoch FROM c)
"""

#: Base32 of the digest: its 160 bits in groups of five.
OP3 = """
WITH p AS (
  SELECT row_number() OVER (ORDER BY page_id NULLS LAST) AS rid, page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT rid, page_id, h, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT), 1) FOR i IN range(0, 32)], '') AS payload_digest
  FROM p),
f AS (SELECT *, first_value(page_id) OVER w AS first_page, row_number() OVER w AS n FROM d WINDOW w AS (PARTITION BY h ORDER BY rid))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN first_page END AS refers_to
FROM f
"""

OP4 = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings),
ok AS (
  SELECT vec_id, label, list_transform(w, lambda x: x / list_max(list_transform(w, lambda y: abs(y)))) AS v FROM e
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(w, lambda x: x <> 0)) > 0
    AND len(list_filter(w, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS to_id FROM ok UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.to_id),
c AS (SELECT node, min(to_id) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, vec_id) AS component_id, vec_id = coalesce(c.component, vec_id) AS kept
FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id
"""



def _runs(name: str, size: int) -> str:
    """Runs `name`(rid, a, b) that windows of `size` bytes cover which start elsewhere too."""
    return f"""w{size} AS (SELECT rid, p, md5(substr(x, 2 * p + 1, {2 * size})) AS m FROM (SELECT rid, x, unnest(range(0, len(x) // 2 - {size - 1})) AS p FROM d WHERE len(x) >= {2 * size})),
s{size} AS (SELECT rid, p FROM w{size} QUALIFY count(*) OVER (PARTITION BY m) > 1),
r{size} AS (SELECT rid, p, CASE WHEN p > lag(p) OVER v + {size} OR lag(p) OVER v IS NULL THEN 1 ELSE 0 END AS begins FROM s{size} WINDOW v AS (PARTITION BY rid ORDER BY p)),
{name} AS (SELECT rid, min(p) AS a, max(p) + {size} AS b FROM (SELECT rid, p, sum(begins) OVER (PARTITION BY rid ORDER BY p) AS k FROM r{size}) GROUP BY rid, k)"""


OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
{_runs("g", 400)},
c AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS after FROM g),
k AS (
  SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
         string_agg(substr(x, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM c JOIN d USING (rid) GROUP BY rid),
{_runs("q", 204)},
u AS (SELECT rid, i, octet_length(encode(m[i])) AS l, octet_length(encode(y[i])) AS gap FROM (
  SELECT rid, m, y, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS m, string_split_regex(t, '[^\\x20\\x09-\\x0D]+') AS y FROM d WHERE rid IN (SELECT rid FROM q)))),
z AS (SELECT rid, sum(gap + l) OVER (PARTITION BY rid ORDER BY i) AS e, l FROM u),
n AS (SELECT rid, count(*) AS n_passages FROM (SELECT q.rid FROM q JOIN z ON z.rid = q.rid AND z.e - z.l >= a AND z.e <= b GROUP BY q.rid, a HAVING count(*) > 50) GROUP BY rid)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN k.rid IS NULL THEN encode(t) ELSE unhex(kept) END) AS kept_sha256, coalesce(n_passages, 0) AS n_passages
FROM d LEFT JOIN k USING (rid) LEFT JOIN n USING (rid)
"""

def _nearest(books: str) -> str:
    """Rows (rid, part, v, entry, d): the entry of `books`(part, entry, c) that is nearest to each part."""
    return f"""(SELECT rid, part, v, k % 64 AS entry, k // 64 AS d FROM (
    SELECT rid, p.part, any_value(v) AS v, min(64 * list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, len(v) + 1)]) + entry) AS k
    FROM p JOIN {books} AS b ON b.part = p.part GROUP BY rid, p.part))"""


def _improved(name: str, books: str) -> str:
    """Entries of `books` at the floored means of their parts."""
    return f"""{name} AS (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {books} AS b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY i) AS c FROM (
      SELECT part, entry, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS mean
      FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM {_nearest(books)}) GROUP BY part, entry, i)
    GROUP BY part, entry) AS m ON m.part = b.part AND m.entry = b.entry)"""


OP13 = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, y) AS rid, vec_id, label, y FROM (
    SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS y FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS (SELECT rid, part, y[part * len(y) // 16 + 1:(part + 1) * len(y) // 16] AS v FROM (SELECT *, unnest(range(0, 16)) AS part FROM k)),
c0 AS (SELECT part, rid - 1 AS entry, v AS c FROM p WHERE rid <= 64),
{_improved("c1", "c0")},
{_improved("c2", "c1")},
a AS (SELECT * FROM {_nearest("c2")}),
r AS (
  SELECT rid, CAST(sum(d) AS BIGINT) AS error, string_agg(substr('0123456789abcdef', CAST(entry // 16 + 1 AS INT), 1) || substr('0123456789abcdef', CAST(entry % 16 + 1 AS INT), 1), '' ORDER BY part) AS code
  FROM a GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM k JOIN r USING (rid)
"""

OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS y
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.uid AS a, a.vec_id AS anchor_id, b.vec_id AS id, b.label = a.label AS alike,
         coalesce(list_sum([a.y[i] * b.y[i] FOR i IN range(1, len(a.y) + 1)]), 0) AS score
  FROM v AS a JOIN v AS b ON a.uid <> b.uid AND len(a.y) = len(b.y) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score
FROM n WHERE rank <= 5
"""

_NOTICES = ", ".join(f"({k}, '{label}', '{words}', '{keys}')" for k, (label, words, keys) in enumerate(TEMPLATES))
_PHRASES = ", ".join(f"('{phrase}', '{label}')" for phrase, label in BASE)

OP12 = f"""
WITH t(t, label, notice, keys) AS (VALUES {_NOTICES}),
bases(phrase, label) AS (VALUES {_PHRASES}),
tw AS (SELECT t, label, len(string_split(notice, ' ')) AS n, unnest(string_split(notice, ' ')) AS w, unnest(range(0, len(string_split(notice, ' ')))) AS i FROM t),
tk AS (SELECT t, unnest(string_split(keys, '|')) AS phrase FROM t),
ph AS (SELECT DISTINCT phrase FROM tk UNION SELECT phrase FROM bases),
pw AS (SELECT phrase, len(string_split(phrase, ' ')) AS n, unnest(string_split(phrase, ' ')) AS w, unnest(range(0, len(string_split(phrase, ' ')))) AS i FROM ph),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
h AS (SELECT * FROM (SELECT rid, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM d) WHERE w IN (SELECT w FROM tw UNION SELECT w FROM pw)),
df AS (SELECT w, count(DISTINCT rid) AS df FROM h GROUP BY w),
o AS (SELECT rid, phrase, p - i AS s, any_value(n) AS n FROM h JOIN pw USING (w) GROUP BY rid, phrase, p - i HAVING count(*) = any_value(n)),
rare AS (
  SELECT rid, t, w FROM (SELECT DISTINCT rid, t, w FROM h JOIN tw USING (w)) JOIN df USING (w)
  QUALIFY row_number() OVER (PARTITION BY rid, t ORDER BY df, w) <= 6),
al AS (SELECT rid, t, h.p - tw.i AS s FROM rare JOIN h USING (rid, w) JOIN tw USING (t, w) GROUP BY ALL HAVING count(*) >= 2),
sh AS (
  SELECT al.rid, al.t, al.s, tw.label, any_value(tw.n) AS n, count(h.w) / any_value(tw.n) AS share
  FROM al JOIN tw USING (t) LEFT JOIN h ON h.rid = al.rid AND h.p = al.s + tw.i AND h.w = tw.w GROUP BY al.rid, al.t, al.s, tw.label),
ok AS (
  SELECT rid, label, max(share) AS share FROM sh
  WHERE share >= 0.6 AND NOT EXISTS (SELECT 1 FROM tk WHERE tk.t = sh.t AND NOT EXISTS (
    SELECT 1 FROM o WHERE o.rid = sh.rid AND o.phrase = tk.phrase AND o.s >= sh.s - 3 AND o.s + o.n <= sh.s + sh.n + 3))
  GROUP BY rid, label),
b AS (SELECT rid, label, s FROM o JOIN bases USING (phrase)),
ba AS (SELECT rid, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY rid),
la AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT rid, label, share FROM ok UNION ALL SELECT rid, label, 0.5 FROM b) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN ba USING (rid) LEFT JOIN la USING (rid)
"""

ORACLES = {"op12_licenses": OP12, "op11_negatives": OP11, "op13_codes": OP13, "op8_repeats": OP8, "op4_vectors": OP4, "op2_mixing": OP2, "op3_warc": OP3, "op1_quality_rules": OP1, "op5_pii": OP5, "op7_secrets": OP7}

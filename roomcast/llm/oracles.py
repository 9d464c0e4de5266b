"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others are checked in tests/llm against brute-force versions: op1 (hashed n-grams
in the engine's own hash), op2 (merges by rank), op5 (random vectors), op10 (token
budgets), op13 (a tokenizer, and which window is open).
"""

from __future__ import annotations

from roomcast.llm.queries import MAX_EPOCHS, SOURCE_WEIGHTS, URL_RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _op3() -> str:
    def fits(host: str, path: str) -> str:
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"

    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    says = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules)
    url = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '{url}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
ruled AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {says} END AS says FROM parts),
seeds AS (SELECT host, count(*) FILTER (says = 'allow') AS allowed, count(*) FILTER (says = 'block') AS blocked
          FROM ruled WHERE host <> '' GROUP BY host),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)) AS href FROM parts),
away AS (SELECT src, translate(regexp_extract(CASE WHEN starts_with(href, '//') THEN 'x:' || href ELSE href END, '{url}', 1),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
         FROM hrefs WHERE starts_with(href, '//') OR contains(href, '://')),
links AS (SELECT src, dst, count(*) AS n FROM away WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
walks AS (SELECT 'trust' AS walk, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
steps AS (SELECT walk, src, dst, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY walk, src) AS p FROM walks),
s0 AS (SELECT 'trust' AS walk, host, 0.15::DOUBLE * allowed AS score FROM seeds WHERE allowed > 0
       UNION ALL SELECT 'distrust', host, 0.15::DOUBLE * blocked FROM seeds WHERE blocked > 0),
moved(walk, host, score) AS (SELECT * FROM s0 UNION ALL
  SELECT m.walk, t.dst, sum(m.score * t.p) FROM moved m JOIN steps t ON t.walk = m.walk AND t.src = m.host GROUP BY 1, 2
  HAVING sum(m.score * t.p) >= 1e-12 * (SELECT max(score) FROM s0)),
judged AS (SELECT host, coalesce(sum(score) FILTER (walk = 'trust'), 0) AS trust,
                  coalesce(sum(score) FILTER (walk = 'distrust'), 0) AS distrust FROM moved GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(says, CASE WHEN distrust > (1 + 1e-9) * trust THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN judged j ON j.host = r.host"""


_OP4 = """
WITH own AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM own),
firsts AS (SELECT h, max(page_id) AS top FROM hashed GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM hashed JOIN firsts USING (h)"""

_OP6 = f"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s FROM words),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM starts JOIN words USING (doc_id)),
repeated AS (SELECT doc_id, s FROM (
  SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS p FROM repeated),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words),
kept AS (SELECT e.doc_id, count(*) AS n, array_to_string(list(word ORDER BY e.p), ' ') AS text
         FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""


def _op7() -> str:
    weights = ", ".join(f"{w}::DOUBLE" for w in SOURCE_WEIGHTS)
    solid = r"regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')"
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS}) AS size,
    greatest(1e-3, coalesce(length(regexp_replace({solid}, '[^\p{{L}}]+', '', 'g'))::DOUBLE / nullif(length({solid}), 0), 1e-3)) AS q,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, ([{weights}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(SOURCE_WEIGHTS)} + 1] AS w
            FROM sized GROUP BY source),
filled AS (SELECT *, {float(MAX_EPOCHS)}::DOUBLE * source_size AS cap,
   (sum(source_size) OVER () - coalesce(sum({float(MAX_EPOCHS)}::DOUBLE * source_size) OVER (ORDER BY {float(MAX_EPOCHS)}::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY {float(MAX_EPOCHS)}::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sources),
targets AS (SELECT *, CASE WHEN cap <= level * w THEN cap ELSE max(CASE WHEN cap > level * w THEN level END) OVER () * w END AS target FROM filled),
plan AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
ordered AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, round(p.target - p.epochs * p.source_size)::BIGINT AS left_over,
   sum(s.size) OVER (PARTITION BY s.source ORDER BY -ln(u) / q, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS before
   FROM sized s JOIN plan p ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, left_over - before)))::BIGINT AS taken FROM ordered"""


_OP8 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words WHERE len(w) > 0),
counts AS (SELECT doc_id, md5(g) AS g, count(*) AS c FROM grams GROUP BY ALL),
sizes AS (SELECT doc_id, sum(c) AS n FROM counts GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS i
           FROM counts a JOIN counts b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * i >= 4 * (p.n + q.n - i)),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN pairs b ON b.x = r.y)
SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x"""

_OP9 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
           FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""



def _crc32(name: str, keys: str) -> str:
    """CTEs up to ``name`` (s, crc): CRC-32 of the strings ``s`` of the relation ``keys``, which must be distinct.

    The register is linear in the message: every byte adds what becomes of it after the bytes behind it.
    """
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384::BIGINT) ELSE {0} >> 1 END"
    bits = ", ".join(f"b{k + 1} AS (SELECT b, {step.format('v')} AS v FROM b{k})" for k in range(8))
    return f"""
b0 AS (SELECT range AS b, range::BIGINT AS v FROM range(256)), {bits},
keyed AS (SELECT s, hex(s) AS h, (length(hex(s)) // 2)::BIGINT AS n FROM {keys}),
behind(k, b, v) AS (SELECT 1::BIGINT, b, v FROM b8 UNION ALL
  SELECT k + 1, behind.b, xor(b8.v, behind.v >> 8) FROM behind JOIN b8 ON b8.b = behind.v & 255 WHERE k < (SELECT max(n) FROM keyed)),
begun(k, v) AS (SELECT 0::BIGINT, 4294967295::BIGINT UNION ALL
  SELECT k + 1, xor(b8.v, begun.v >> 8) FROM begun JOIN b8 ON b8.b = begun.v & 255 WHERE k < (SELECT max(n) FROM keyed)),
octets AS (SELECT s, n, unnest(range(0, n)) AS i, h FROM keyed),
summed AS (SELECT s, n, bit_xor(v) AS v FROM octets JOIN behind ON k = n - i AND b = ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT GROUP BY s, n),
{name} AS (SELECT s, xor(xor(summed.v, begun.v), 4294967295::BIGINT)::BIGINT AS crc FROM summed JOIN begun ON k = n)"""


_OP11 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
{_crc32("hashed", "counted")},
harmed AS (SELECT CASE WHEN crc % 199 = 0 THEN left(run, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2) ELSE run END AS word, n
           FROM counted JOIN hashed USING (s)),
words AS (SELECT word, sum(n)::BIGINT AS n FROM harmed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS x, b.word AS y FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.rest
          UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest),
near AS (SELECT x AS word, count(*) AS n_near, arg_min(y, (-n, encode(y))) AS best FROM pairs JOIN words ON words.word = y GROUP BY x),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN f.n >= 5 * w.n THEN f.word END AS form, CASE WHEN f.n >= 5 * w.n THEN f.n END AS form_n
          FROM words w LEFT JOIN near ON near.word = w.word LEFT JOIN words f ON f.word = near.best),
chain(word, top, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form)
SELECT word, f.form, top AS root, n, n_near, form_n FROM forms f JOIN chain c USING (word) WHERE c.form IS NULL"""

_OP12 = rf"""
WITH RECURSIVE chats AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
places AS (SELECT DISTINCT s FROM chats),
{_crc32("hashed", "places")},
harmed AS (SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
    CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(0, CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM chats JOIN hashed USING (s)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS solid FROM harmed),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM ordered),
judged AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS previous FROM marked),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND previous || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM judged GROUP BY conv_id),
inserts(a, b, c, w) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
    (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')),
edits(a, b, c, w, role) AS (VALUES (0, 0, 3, 'D', NULL), (1, 1, 3, 'D', NULL), (2, 2, 3, 'D', NULL), (3, 3, 3, 'D', NULL),
    (0, 2, 2, 'R', NULL), (1, 2, 2, 'R', NULL), (3, 2, 2, 'R', NULL), (2, 3, 2, 'R', NULL),
    (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a')),
dp(conv_id, pos, state, cost, audit) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '' FROM counts
  UNION ALL
  SELECT d.conv_id, j.pos, e.b, min(d.cost + i.c + e.c + CASE WHEN e.w <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END),
    arg_min(d.audit || i.w || e.w, (d.cost + i.c + e.c + CASE WHEN e.w <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END, d.audit || i.w || e.w))
  FROM dp d JOIN judged j ON j.conv_id IS NOT DISTINCT FROM d.conv_id AND j.pos = d.pos + 1
  JOIN inserts i ON i.a = d.state
  JOIN edits e ON e.a = i.b AND (e.w = 'D' OR coalesce(j.fault, '') NOT IN ('blank', 'duplicate')) AND (e.role IS NULL OR e.role = left(j.role, 1))
  GROUP BY 1, 2, 3),
chosen AS (SELECT d.conv_id, min(d.cost + i.c) AS cost, arg_min(d.audit || i.w, (d.cost + i.c, d.audit || i.w)) AS audit
  FROM dp d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.pos JOIN inserts i ON i.a = d.state AND i.b IN (0, 3) GROUP BY 1),
letters AS (SELECT conv_id, k, audit[k] AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM chosen)),
walked AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS pos FROM letters),
kept AS (SELECT w.conv_id, w.k, w.e, j.role, j.text, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.k) AS place
  FROM walked w LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos AND w.e <> 'I' WHERE w.e <> 'D'),
headed AS (SELECT *, max(CASE WHEN place = 1 AND e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS head FROM kept),
lines AS (SELECT conv_id, place, CASE WHEN e = 'K' THEN role WHEN (place - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM headed),
written AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS h FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM o.conv_id"""

ORACLES: dict[str, str] = {
    "op3_host_trust": _op3(),
    "op4_warc_zst": _OP4,
    "op6_fm_dedup": _OP6,
    "op7_source_mix": _op7(),
    "op8_bagminhash": _OP8,
    "op9_cover_tree": _OP9,
    "op11_spelling": _OP11,
    "op12_turn_repair": _OP12,
}

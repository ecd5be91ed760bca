"""SQL twins for DuckDB of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPLIT}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, b FROM reach JOIN edges ON a = r)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS ws FROM documents),
b AS (
  SELECT item_id, ws, least(13, len(ws)) AS n
  FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS ws FROM benchmark) WHERE len(ws) > 0),
asked AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS key
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM b)),
spots AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS key
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM asked) WHERE len(ws) >= n)),
found AS (SELECT doc_id, n, i, item_id FROM spots JOIN asked USING (n, key)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
n AS (SELECT a AS vec_id, count(*) AS n FROM edges GROUP BY a),
reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN edges ON a = r)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(r) AS component_id, min(r) = vec_id AS kept
FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPLIT}') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS key
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
firsts AS (SELECT key, min(doc_id) AS first FROM win GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (key) WHERE first < doc_id),
spots AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM spots ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: crc32 of a text of ASCII characters: the table of bytes follows from the reversed polynomial.
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab"""


def _crc(text: str) -> str:
    """crc32 of a text column, with ``tab`` at hand."""
    return (f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), "
            "lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295)")


PERIODIC_RUNS = f"""
WITH t AS ({_CRC_TABLE}),
d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPLIT}') AS ws, {_crc("doc_id::VARCHAR")} AS h FROM documents, t),
e AS (SELECT *, h // 10 AS g, len(ws) AS n FROM d),
f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
x AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM p),
six AS (
  SELECT doc_id, i, array_to_string(ws[i + 1:i + 6], ' ') AS key FROM (
    SELECT doc_id, ws, unnest(range(n - 5)) AS i FROM x WHERE n >= 6)),
again AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM six a JOIN six b ON a.doc_id = b.doc_id AND a.key = b.key AND a.i < b.i),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM again),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + 5 + q AS len FROM island GROUP BY doc_id, q, k),
runs AS (
  SELECT doc_id, s, len, min(q) AS q FROM stretch WHERE len >= greatest(12, 2 * q) GROUP BY doc_id, s, len),
told AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, len := len, q := q), struct_pack(a := -len, b := s, c := q)) AS best,
         string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
spots AS (SELECT doc_id, unnest(range(n)) AS i, unnest(ws) AS word FROM x),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM spots ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period,
       1000 * best.len // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM x LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_END = "[{'c': 0, 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''}]"


def _edited(state: int) -> str:
    """Cheapest cost to go and least letters when the row's message is edited in this state."""
    after = {0: 3, 1: 3, 2: 4, 3: 3}[state]  # 1-based place of the state behind an inserted or other role
    keep = " ".join(f"WHEN i = '{i}' THEN v[{to}]" for i, to in {0: [("s", 2), ("u", 3)], 1: [("u", 3)], 2: [("a", 4)], 3: [("u", 3)]}[state])
    return f"""list_min([{{'c': v[{state + 1}].c + 4, 'a': 'D' || v[{state + 1}].a}}] || CASE WHEN fault IN (1, 2) THEN [] ELSE
      [{{'c': v[{after}].c + 3 + cut, 'a': 'R' || v[{after}].a}}] || CASE WHEN CASE {keep} END IS NULL THEN [] ELSE
        [{{'c': (CASE {keep} END).c + cut, 'a': 'K' || (CASE {keep} END).a}}] END END)"""


def _inserted(state: int) -> str:
    one = {0: 3, 1: 3, 2: 4, 3: 3}[state]
    two = {3: 4, 4: 3}[one]
    return f"list_min([e[{state + 1}], {{'c': e[{one}].c + 3, 'a': 'I' || e[{one}].a}}, {{'c': e[{two}].c + 6, 'a': 'II' || e[{two}].a}}])"


CONVERSATIONS = f"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT named.*, {_crc("name")} % 20 AS h FROM named, t),
bad AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE h <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM bad),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth,
         regexp_extract_all(text, '[^\\x20\\x09-\\x0D]') AS body, coalesce(conv_id::VARCHAR, '-') AS conv FROM num),
msg AS (
  SELECT *, left(role, 1) AS i, CASE WHEN len(body) = 0 THEN 1 WHEN nth > 1 THEN 2 WHEN body[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM seen),
steps AS (SELECT conv, k, i, fault, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS cut FROM msg),
sizes AS (SELECT conv, max(k) AS n FROM msg GROUP BY conv),
dp(conv, k, v) AS (
  SELECT conv, n, {_END} FROM sizes
  UNION ALL
  SELECT conv, k - 1, [{", ".join(_inserted(s) for s in range(4))}] FROM (
    SELECT dp.conv, dp.k, [{", ".join(_edited(s) for s in range(4))}] AS e
    FROM dp JOIN steps ON dp.conv = steps.conv AND dp.k = steps.k)),
won AS (SELECT conv, v[1].c AS cost, v[1].a AS audit FROM dp WHERE k = 0),
letters AS (SELECT conv, spot, audit[spot] AS l FROM (SELECT conv, audit, unnest(range(1, len(audit) + 1)) AS spot FROM won)),
placed AS (
  SELECT conv, spot, l, sum(CASE WHEN l <> 'I' THEN 1 ELSE 0 END) OVER w AS k, sum(CASE WHEN l <> 'D' THEN 1 ELSE 0 END) OVER w AS j,
         sum(CASE WHEN l <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS total
  FROM letters WINDOW w AS (PARTITION BY conv ORDER BY spot)),
lines AS (
  SELECT p.conv, spot, CASE WHEN l = 'K' THEN role WHEN (j + total) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
         CASE WHEN l = 'I' THEN '' ELSE text END AS line
  FROM placed p LEFT JOIN msg m ON m.conv = p.conv AND m.k = p.k WHERE l <> 'D'),
fixed AS (SELECT conv, string_agg(line, chr(10) ORDER BY spot) AS text FROM lines GROUP BY conv),
pairs AS (SELECT conv, lag(i) OVER (PARTITION BY conv ORDER BY k) || i AS two FROM msg),
broken AS (SELECT conv, sum(CASE WHEN two NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS n FROM pairs GROUP BY conv),
told AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated
  FROM msg GROUP BY conv)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(broken.n, 0)::BIGINT AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(fixed.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '-') AS conv FROM conversations) o
LEFT JOIN told USING (conv) LEFT JOIN broken USING (conv) LEFT JOIN won USING (conv) LEFT JOIN fixed USING (conv)
"""

#: Classes of the characters of words; what is left are stops.
_CLASSES = ["a-z", "A-Z", "0-9", None, r"#*$%&|<>", r"\x00-\x08\x0E-\x1F\x7F", r"\x{80}-\x{2FF}", r"\x{300}-\x{1FFF}",
            r"\x{3000}-\x{DFFF}", r"\x{2000}-\x{2FFF}\x{E000}-\x{10FFFF}"]
_COUNTED = ", ".join("0" if c is None else f"length(regexp_replace(t, '[^{c}]', '', 'g'))" for c in _CLASSES)


def _divergence(p: str, q: str) -> str:
    """Twice the Jensen-Shannon divergence in bits, over the bins with p > 0, less the q there."""
    m = f"(({p} + {q}) / 2)"
    return f"{p} * log2({p} / {m}) + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END - {q}"


QUALITY = f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t,
         regexp_extract_all(coalesce(text, ''), '{_SPLIT}') AS ws, regexp_extract_all({_LOWER}, '{_SPLIT}') AS low FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_SPLIT}') GROUP BY doc_id),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS key
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, key FROM win GROUP BY doc_id, key HAVING count(*) > 1),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM win JOIN twice USING (doc_id, key)) GROUP BY doc_id),
c0 AS (SELECT doc_id, lang, low, len(ws) AS n_words, length(t) AS word_chars, [{_COUNTED}] AS c FROM d),
c1 AS (
  SELECT doc_id, lang, low, n_words, word_chars, c[5] AS n_symbols, c[:3] || [word_chars - list_sum(c)] || c[5:] AS c,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM c0 LEFT JOIN lines USING (doc_id) LEFT JOIN hit USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c1),
spots AS (SELECT doc_id, unnest(low) AS w FROM base),
tf AS (SELECT doc_id, w, count(*) AS n FROM spots GROUP BY doc_id, w),
known AS (
  SELECT coalesce('=' || lang, '') AS name FROM base WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= 2000),
good AS (SELECT doc_id, '=' || lang AS name FROM base WHERE NOT base_failed UNION ALL SELECT doc_id, '' FROM base WHERE NOT base_failed),
ref_c AS (
  SELECT name, k, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY name) AS total FROM (
    SELECT name, unnest(range(1, 11)) AS k, unnest(c) AS n FROM good JOIN base USING (doc_id)) GROUP BY name, k),
ref_w AS (
  SELECT name, w, count(*) AS docs, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY name) AS total FROM good JOIN tf USING (doc_id) GROUP BY name, w),
placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY docs DESC) AS place FROM ref_w),
common AS (
  SELECT name, w, n, total, sum(n) OVER (PARTITION BY name) AS inside, count(*) OVER (PARTITION BY name) AS bins FROM placed p
  WHERE place <= 64 AND docs > coalesce((SELECT docs FROM placed q WHERE q.name = p.name AND q.place = 65), 0)),
own AS (SELECT doc_id, coalesce(known.name, '') AS name FROM base LEFT JOIN known ON known.name = '=' || base.lang),
pc AS (SELECT doc_id, unnest(range(1, 11)) AS k, unnest(c) AS n, word_chars FROM base),
dc AS (
  SELECT doc_id, 1 + sum({_divergence("(pc.n / word_chars)", "(r.n / r.total)")}) AS js
  FROM pc JOIN own USING (doc_id) JOIN ref_c r ON r.name = own.name AND r.k = pc.k WHERE pc.n > 0 GROUP BY doc_id),
pw AS (
  SELECT doc_id, coalesce(common.w, chr(10)) AS w, sum(tf.n) AS n, any_value(common.n) AS q
  FROM tf JOIN own USING (doc_id) LEFT JOIN common ON common.name = own.name AND common.w = tf.w WHERE own.name <> '' GROUP BY ALL),
sizes AS (SELECT DISTINCT name, total, inside, bins FROM common),
dw AS (
  SELECT doc_id, any_value(bins) AS bins, 1 + sum({_divergence("(pw.n / n_words)", "(coalesce(q, total - inside) / total)")}) AS js
  FROM pw JOIN own USING (doc_id) JOIN sizes USING (name) JOIN base USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(word_chars >= 200 AND dc.js / 2 > 0.25 * 0.25 + 9 / (8 * ln(2) * word_chars), false)
         AND NOT coalesce(n_words >= 50 AND dw.js / 2 > 0.3 * 0.3 + bins / (8 * ln(2) * n_words), false) AS kept
FROM base LEFT JOIN dc USING (doc_id) LEFT JOIN dw USING (doc_id)
"""

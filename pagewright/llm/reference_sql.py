"""DuckDB SQL for the queries that SQL can express; the tests compare the others with brute force."""

from __future__ import annotations

from pagewright.llm import sharding as S
from pagewright.llm import url_filter as U

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format


def _rule_cases() -> str:
    cases = []
    for verdict, host, path in sorted(U.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        cases.append(f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{path}') THEN ['{host}{path}', '{verdict}']")
    return "CASE " + " ".join(cases) + " END"


def _smoothed(kind: str) -> str:
    """Tables {kind}1 to {kind}3: chances of a symbol after no, one and two symbols."""
    s, a = U.SYMBOLS, kind
    seen = "(sum(n) OVER ({0}))".format
    kinds = "(count(*) FILTER (n > 0) OVER ({0}))".format

    def plain(part, lower):
        return f"CASE WHEN {seen(part)} = 0 THEN {lower} ELSE (n + {kinds(part)} * {lower}) / ({seen(part)} + {kinds(part)}) END"

    return f"""{a}0 AS (SELECT i AS id, i // {s} AS before, (i // {s}) % {s} AS last, i % {s} AS c, coalesce({a}, 0)::DOUBLE AS n
  FROM range({s ** 3}) t(i) LEFT JOIN counts ON gram = i),
{a}b AS (SELECT last, c, sum(n) AS n FROM {a}0 GROUP BY ALL), {a}u AS (SELECT c, sum(n) AS n FROM {a}b GROUP BY ALL),
{a}1 AS (SELECT c, {plain('', f'(1 / {s}::DOUBLE)')} AS q FROM {a}u),
{a}2 AS (SELECT last, c, {plain('PARTITION BY last', 'q')} AS q FROM {a}b JOIN {a}1 USING (c)),
{a}3 AS (SELECT id, {plain('PARTITION BY before', 'q')} AS p FROM {a}0 JOIN {a}2 USING (last, c))"""


_AUTHORITY = "regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*')"
_STEPS = int(U.SPAN / U.STEP)

URL_FILTER = f"""WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN {_LOWER(_AUTHORITY)} ELSE '' END AS host,
  CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
f AS (SELECT *, {_rule_cases()} AS found FROM u),
k AS (SELECT page_id, url, host, path, found[1] AS rule, found[2] AS verdict,
  list_transform(string_split(regexp_replace({_LOWER("coalesce(url, '')")}, '[^{U.ALPHABET.replace("-", "")}-]', '~', 'g'), ''),
    lambda x: instr('{U.ALPHABET}~', x)) AS codes, ('0x' || substr(md5(url), 1, 8))::BIGINT % {U.FOLDS} AS fold FROM f),
g AS (SELECT page_id, verdict, fold, unnest(list_transform(range(1, len(codes) + 1), lambda i:
  (CASE WHEN i > 2 THEN codes[i - 2] ELSE 0 END * {U.SYMBOLS} + CASE WHEN i > 1 THEN codes[i - 1] ELSE 0 END) * {U.SYMBOLS} + codes[i])) AS gram FROM k),
counts AS (SELECT gram, count(*) FILTER (verdict = 'allow') AS allow, count(*) FILTER (verdict = 'block') AS block
  FROM g WHERE verdict IS NOT NULL AND fold > 0 GROUP BY gram),
{_smoothed('allow')},
{_smoothed('block')},
w AS (SELECT id, ln(allow3.p) - ln(block3.p) AS w FROM allow3 JOIN block3 USING (id)),
d AS (SELECT page_id, sum(w) / count(*) AS difference FROM g JOIN w ON gram = id GROUP BY page_id),
j AS (SELECT k.*, coalesce(difference, 0) AS difference FROM k LEFT JOIN d USING (page_id)),
b AS (SELECT greatest(-{_STEPS}, least({_STEPS}, floor(difference / {U.STEP}::DOUBLE)))::INT AS bin, count(*) FILTER (verdict = 'allow') AS a,
  count(*) FILTER (verdict = 'block') AS b FROM j WHERE verdict IS NOT NULL AND fold = 0 GROUP BY ALL),
r AS (SELECT bin, sum(a) OVER (ORDER BY bin DESC) AS kept, sum(a) OVER () AS a, sum(b) OVER (ORDER BY bin) - b AS dropped, sum(b) OVER () AS b FROM b),
t AS (SELECT coalesce((SELECT bin FROM r WHERE a > 0 AND b > 0 ORDER BY kept / a + dropped / b DESC, abs(bin), bin LIMIT 1) * {U.STEP}::DOUBLE, 0) AS threshold)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN difference >= threshold THEN 'allow' ELSE 'block' END) AS verdict,
  round(difference, 6) AS difference, threshold FROM j, t"""

NGRAM_JOIN = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common, any_value(x.n) AS n, any_value(y.n) AS m
  FROM e x JOIN e y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, common = n AND common = m AS same FROM p WHERE common >= 0.8 * (n + m - common) - 1e-9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT doc_id, least(doc_id, min(b)) AS class_id FROM documents LEFT JOIN r ON a = doc_id GROUP BY doc_id),
k AS (SELECT doc_id, least(doc_id, min(b)) AS copy_id, count(b) AS copies FROM documents LEFT JOIN l ON a = doc_id AND same GROUP BY doc_id),
n AS (SELECT a AS doc_id, count(*) AS links, count(DISTINCT copy_id) AS linked_sets FROM l JOIN k ON b = k.doc_id WHERE NOT same GROUP BY a)
SELECT doc_id, class_id, copy_id, copies, coalesce(links, 0) AS links, coalesce(linked_sets, 0) AS linked_sets
FROM c JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""

CHAT = f"""WITH e AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, role, text,
  conv_id || ':' || CASE role WHEN 'assistant' THEN turn - 1 ELSE turn END AS call_id FROM conversations),
l AS (SELECT call_id FROM e GROUP BY call_id HAVING bool_or(kind = 'call') AND bool_or(kind = 'result'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind, call_id) - 1 AS place, kind, call_id, turn,
  kind <> 'message' AND call_id IN (SELECT call_id FROM l) AS linked, true AS valid, '' AS errors, false AS cyclic,
  CASE kind WHEN 'call' THEN '{{"arguments":{{' || CASE WHEN turn >= 2 THEN '"after":"' || conv_id || ':' || (turn - 2) || '",' ELSE '' END
    || '"text":' || to_json(text) || ',"turn":' || turn || '}},"errors":[],"id":"' || call_id || '","kind":"call","name":"reply"}}'
  WHEN 'result' THEN '{{"content":' || to_json(text) || ',"id":"' || call_id || '","kind":"result"}}'
  ELSE '{{"content":' || to_json(text) || ',"id":"' || call_id || '","kind":"message","role":"' || role || '"}}' END AS json FROM e"""

# Checksums bit by bit: a table of 256 entries from the polynomial, then one step per byte.
SHARDING = f"""WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps),
h AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents),
z AS (SELECT doc_id, text, coalesce(length(h) // 2, 0) + 1 AS size, xor(list_reduce(list_concat([4294967295],
    list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM h, k),
s AS (SELECT *, (sum(size) OVER w - size)::BIGINT AS start, (sum(size) OVER ())::BIGINT AS total, row_number() OVER w AS number
  FROM z WINDOW w AS (ORDER BY text_crc32 NULLS FIRST, text, doc_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, least({S.SHARDS - 1}, ((2 * start + size) * {S.SHARDS}) // (2 * total)) AS middle FROM s),
g AS (SELECT *, sum(size) OVER v AS bytes, min(start) OVER v AS first, min(middle) OVER v AS low, max(middle) OVER v AS high
  FROM m WINDOW v AS (PARTITION BY text)),
p AS (SELECT *, CASE WHEN low < high AND bytes * {S.SHARDS} <= {S.WHOLE} * total
  THEN least({S.SHARDS - 1}, ((2 * first + bytes) * {S.SHARDS}) // (2 * total)) ELSE middle END::INTEGER AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, number - min(number) OVER (PARTITION BY shard) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM p"""

def _crc32(hexadecimal: str) -> str:
    """Checksum of bytes given in hexadecimal, with the table `k` of SHARDING."""
    return f"""xor(list_reduce(list_concat([4294967295], list_transform(range(length({hexadecimal}) // 2),
    lambda i: ('0x' || substr({hexadecimal}, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""


_STEPS_TABLE = """k AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps)"""

# By the definition: all pairs of equal words of a text, stretches of pairs at one distance, the smallest distance of each stretch.
PERIODIC = f"""WITH {_STEPS_TABLE},
h AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  hex(encode(doc_id::VARCHAR)) AS x FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, {_crc32('x')} AS h FROM h, k),
a AS (SELECT doc_id, w, n, h, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM g),
p AS (SELECT doc_id, w, n, a, h % 10 = 0 AND n > 0 AS looped, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN looped THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
e AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM t),
m AS (SELECT y.doc_id, y.i, y.i - x.i AS lag FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND y.i - x.i <= x.n // 3),
s AS (SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS stretch FROM m),
f AS (SELECT doc_id, lag, min(i) - lag AS start, count(*) + lag AS length FROM s GROUP BY doc_id, lag, stretch HAVING count(*) + lag >= greatest(24, 3 * lag)),
r AS (SELECT doc_id, start, length, min(lag) AS period FROM f GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, (-(length / period), start, period)) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM e
  WHERE NOT EXISTS (FROM r WHERE r.doc_id = e.doc_id AND e.i >= r.start + r.period AND e.i < r.start + r.length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period::BIGINT AS period,
  (1000 * best.length) // best.period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""

# Every prefix of every conversation as a list of digests; subtrees are the prefixes of the conversation that names a node.
PREFIX_TRIE = f"""WITH {_STEPS_TABLE},
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
  {{'k': sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'c': length(coalesce(text, ''))}} AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(turn ORDER BY place) AS turns, hex(encode(conv_id::VARCHAR)) AS x FROM o GROUP BY conv_id),
h AS (SELECT conv_id, turns, {_crc32('x')} % 6 AS h FROM l, k),
s AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM h c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth, turns FROM s),
q AS (SELECT conv_id, size, depth, turns[1:depth] AS prefix, CASE WHEN depth > 0 THEN turns[depth].c ELSE 0 END AS c FROM p),
n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(c) AS c,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends FROM q GROUP BY prefix, depth),
d AS (SELECT a.prefix AS top, n.prefix <> a.prefix AND n.depth = a.depth + 1 AS child, n.* FROM n JOIN q a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
z AS (SELECT prefix, count(*) FILTER (child) AS n_children FROM (SELECT top AS prefix, child FROM d) GROUP BY prefix),
y AS (SELECT d.top AS prefix, count(*) FILTER (z.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.c)::BIGINT AS saved_tokens
  FROM d JOIN z ON z.prefix = d.prefix GROUP BY d.top)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, z.n_children, y.n_leaves, y.saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN z USING (prefix) JOIN y USING (prefix) LEFT JOIN n m ON n.depth > 0 AND m.prefix = n.prefix[1:n.depth - 1]"""

ORACLE = {
    "op1_sharding": SHARDING, "op2_url_filter": URL_FILTER, "op5_ngram_join": NGRAM_JOIN, "op7_chat": CHAT, "op12_periodic": PERIODIC,
    "op13_prefix_trie": PREFIX_TRIE}

"""DuckDB SQL twins of the training-data queries that SQL can express.

``op2`` and ``op4`` (fitted models), ``op3`` (suffix arrays) and ``op5`` (a
tokenizer) have none; their tests compare with brute force or held-out labels.
"""

from __future__ import annotations

from .chat_collapse import END, START
from .host_reputation import RULES, TWO_LABEL_SUFFIXES, Reputation

W = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op1_chat_collapse"] = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, role, text,
             row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
h AS (SELECT conv_id, pos, n_turns,
             list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM p),
last AS (SELECT n_turns, upto, min(conv_id) AS conv_id, count(*) AS n_copies FROM h WHERE pos = n_turns GROUP BY n_turns, upto),
kept AS (SELECT * FROM last l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pos = l.n_turns AND h.n_turns > h.pos AND h.upto = l.upto))
SELECT k.conv_id, k.n_turns, k.n_copies,
       string_agg('{START}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{END}' || chr(10), '' ORDER BY p.pos) AS chat
FROM kept k JOIN p USING (conv_id) GROUP BY ALL"""


def _rule_sql() -> tuple[str, str]:
    text, verdict = "NULL", "NULL"
    for v, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        text = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {text} END"
        verdict = f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    return text, verdict


def _level_sql(name: str, children: str, parents: str, key: str, unit: str, how: Reputation) -> str:
    return f"""
{name}_j AS (SELECT c.*, q.a / (q.a + q.b) AS m FROM {children} c JOIN {parents} q USING ({key})),
{name}_v AS (SELECT (sum(n * pow(k / n - m, 2)) - sum(m * (1 - m))) / greatest(sum(n) - count(*), 1) AS between_,
                    sum(n * m * (1 - m)) / sum(n) AS within_ FROM {name}_j WHERE n > 0),
{name}_s AS (SELECT greatest({how.min_strength}, least({how.max_strength},
             coalesce(CASE WHEN between_ > 1e-9 THEN within_ / between_ - 1 END, {how.max_strength}))) AS s FROM {name}_v),
{name} AS (SELECT {unit}, m * s + k AS a, (1 - m) * s + n - k AS b FROM {name}_j, {name}_s)"""


def _hosts_sql() -> str:
    text, verdict = _rule_sql()
    how = Reputation()
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    parts = "string_split(host, '.')"
    tail = lambda n: f"array_to_string({parts}[greatest(1, len({parts}) - {n - 1}):], '.')"
    address = "regexp_full_match(host, '[0-9.]+(:[0-9]+)?')"
    return f"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
good AS (SELECT doc_id AS page_id, count(*) AS n, sum((coalesce(quality = 1, true) AND coalesce(toxic <> 1, true))::INT) AS k
         FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k FROM p LEFT JOIN good USING (page_id) GROUP BY host),
hosts AS (SELECT *,
   CASE WHEN {address} THEN host WHEN {tail(2)} IN ({two}) THEN {tail(3)} ELSE {tail(2)} END AS domain,
   CASE WHEN {address} THEN '' WHEN {tail(2)} IN ({two}) THEN {tail(2)} ELSE {tail(1)} END AS suffix FROM c),
domains AS (SELECT domain, first(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, 1 AS top FROM domains GROUP BY suffix),
tops AS (SELECT 1 AS top, sum(k) + 1.0 AS a, sum(n) - sum(k) + 1.0 AS b FROM suffixes),
{_level_sql('ps', 'suffixes', 'tops', 'top', 'suffix', how)},
{_level_sql('pd', 'domains', 'ps', 'suffix', 'domain', how)},
{_level_sql('ph', 'hosts', 'pd', 'domain', 'host', how)},
bounds AS (SELECT host, a / (a + b) - {how.z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ph)
SELECT page_id, host, path, {text} AS rule,
       coalesce({verdict}, CASE WHEN bound >= {how.min_rate} OR (SELECT sum(n) FROM c) = 0 THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN bounds USING (host)"""


ORACLES["op6_host_reputation"] = _hosts_sql()

ORACLES["op7_bsi_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
WHERE rank <= 5"""

ORACLES["op8_ngram_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
                      WHEN len(ws) > 0 THEN [len(ws)::VARCHAR || '|' || array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
toks AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
df AS (SELECT t FROM toks GROUP BY t HAVING count(*) > 1),
shared AS (SELECT doc_id, n, t FROM toks SEMI JOIN df USING (t)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
          FROM shared a JOIN shared b ON a.t = b.t AND a.doc_id < b.doc_id
           AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 85 * (na + nb - i)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS c FROM sets
          UNION SELECT both_.b, reach.c FROM reach JOIN both_ ON both_.a = reach.node WHERE reach.c < both_.b)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(c) FROM reach WHERE node = doc_id) AS component_id FROM sets"""

ORACLES["op9_mix_sources"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{W}')), 0)::BIGINT AS size,
                  md5(concat_ws('|', '7', doc_id::VARCHAR, md5(text))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] ::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS total_w,
             coalesce(sum(cap) OVER o, 0) AS full_, coalesce(sum(w) OVER o, 0) AS full_w
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - full_) / (total_w - full_w) AS level FROM r),
m AS (SELECT max(level) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, CASE WHEN m.level IS NULL OR m.level * w >= cap THEN cap ELSE m.level * w END AS target FROM l, m),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
        + greatest(0, least(size, budget - (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * source_size - ahead)))::BIGINT AS taken
FROM b"""

ORACLES["op10_quality_cascade"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{W}') AS ws, row_number() OVER () AS rid FROM documents),
l AS (SELECT rid, line, count(*) AS m FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '{W}') GROUP BY rid, line),
ln AS (SELECT rid, sum(m)::BIGINT AS n_lines, sum(m - 1)::BIGINT AS n_dup_lines FROM l GROUP BY rid),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS m FROM (
        SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))),
rep AS (SELECT rid, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM g WHERE m > 1) GROUP BY rid),
s AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[a-z]')) AS n_lower,
        len(regexp_extract_all(text, '[!?]')) AS n_marks, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha
      FROM d LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words
       OR 2 * n_upper > n_upper + n_lower OR 5 * n_marks > n_words OR 10 * n_alpha < 7 * n_words) AS kept
FROM b"""

ORACLES["op11_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
             coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.nth <= 5 AND s.anchor_id = p.anchor_id AND NOT s.same
           AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

# CRC-32 by its polynomial; the cheapest edits by grammar state, a row a step of
# the recursion, each state with up to two inserts before the row's own edit.
ORACLES["op13_structure_repair"] = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS chars FROM conversations),
c AS (SELECT conv_id, turn, role, text, xor(list_reduce([4294967295::BIGINT] || list_transform(chars, lambda x: ascii(x)::BIGINT),
             lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS d FROM k, tab),
g AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, d FROM c WHERE d <> 0),
r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
      FROM (SELECT * FROM g UNION ALL SELECT * FROM g WHERE d = 3)),
e AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r),
f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM e),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
             count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
nxt(q, x, z) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
ins(q, z, c, a) AS (VALUES ('0', '0', 0, ''), ('0', 'u', 5, 'I'), ('0', 'a', 10, 'II'), ('s', 's', 0, ''), ('s', 'u', 5, 'I'), ('s', 'a', 10, 'II'),
                           ('u', 'u', 0, ''), ('u', 'a', 5, 'I'), ('a', 'a', 0, ''), ('a', 'u', 5, 'I')),
act AS (SELECT conv_id, i, 'D' AS a, 2 AS c, x, fault FROM f
        UNION ALL SELECT conv_id, i, 'R', CASE WHEN fault = 't' THEN 6 ELSE 1 END, x, fault FROM f WHERE fault IN ('', 't')
        UNION ALL SELECT conv_id, i, 'K', CASE WHEN fault = 't' THEN 5 ELSE 0 END, x, fault FROM f WHERE fault IN ('', 't')),
dp AS (SELECT conv_id, 0::BIGINT AS i, '0' AS q, {'c': 0::BIGINT, 'a': ''} AS v FROM counts
       UNION ALL
       SELECT p.conv_id, p.i + 1, CASE act.a WHEN 'D' THEN ins.z WHEN 'R' THEN CASE WHEN ins.z = 'u' THEN 'a' ELSE 'u' END ELSE nxt.z END AS z,
              min({'c': (p.v.c + ins.c + act.c)::BIGINT, 'a': p.v.a || ins.a || act.a})
       FROM dp p JOIN ins ON ins.q = p.q JOIN act ON act.conv_id IS NOT DISTINCT FROM p.conv_id AND act.i = p.i + 1
       LEFT JOIN nxt ON nxt.q = ins.z AND nxt.x = act.x WHERE act.a <> 'K' OR nxt.z IS NOT NULL GROUP BY ALL),
best AS (SELECT n.conv_id, min({'c': (p.v.c + ins.c)::BIGINT, 'a': p.v.a || ins.a}) AS v
         FROM dp p JOIN counts n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.i JOIN ins ON ins.q = p.q AND ins.z IN ('0', 'a') GROUP BY n.conv_id),
l AS (SELECT conv_id, j, v.a[j] AS a, j - len(replace(v.a[:j], 'I', '')) AS inserts, len(replace(v.a[:j], 'D', '')) AS o
      FROM (SELECT conv_id, v, unnest(range(1, len(v.a) + 1)) AS j FROM best)),
m AS (SELECT l.conv_id, l.j, l.a, l.o, f.role, f.text, l.a = 'K' AND l.o = 1 AND f.x = 's' AS leads
      FROM l LEFT JOIN f ON l.a <> 'I' AND f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.j - l.inserts WHERE l.a <> 'D'),
w AS (SELECT *, max(leads::INT) OVER (PARTITION BY conv_id) AS shift FROM m),
t AS (SELECT conv_id, string_agg(CASE WHEN a = 'K' THEN role WHEN (o - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END
             || ':' || CASE WHEN a = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body FROM w GROUP BY conv_id)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
       coalesce(n.illegal, 0) AS illegal, coalesce(b.v.c, 0) AS cost, coalesce(b.v.a, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""

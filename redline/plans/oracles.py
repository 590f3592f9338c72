"""DuckDB SQL for the correctness oracles.

The alignment oracle restates the longest-matching-block rule set-wise:

* a *cell* is a pair (i, j) with ``a[i] = b[j]``; a cell is *popular* when the
  corrected side has >= 200 tokens and its token occurs there more than
  ``n // 100 + 1`` times (such tokens cannot seed a match);
* diagonal runs of consecutive cells form *islands*, once over non-popular
  cells (seeds) and once over all cells (extension);
* for an interval, the best seed is the longest clipped non-popular island,
  ties to the smallest end i, then the smallest end j; it is extended to the
  clipped all-cell island that contains it (with no seed, the island through
  the interval's corner, if any);
* a recursive CTE splits every interval around its block, level by level.

Tags follow from the blocks: inside a block KEEP; between two blocks an
equal-length span is REPLACE by position, anything else DELETE, and the
corrected span of an unequal or insert segment goes to the gap at the
segment's end.
"""

from __future__ import annotations

from ..functions.text import WS_RUN
from ..sources.io import NA_WORDS

def tokenize_sql(expr: str) -> str:
    """DuckDB twin of ``functions.text.tokenize``."""
    return f"list_filter(regexp_split_to_array({expr}, '{WS_RUN}'), lambda t: t <> '')"


def _best_block(rel: str) -> str:
    """Best (extended) block of every interval in relation ``rel``."""
    return f"""
SELECT g.pair_id, g.alo, g.ahi, g.blo, g.bhi,
       CASE WHEN x.si IS NULL THEN 0
            ELSE least(x.ei, g.ahi - 1, g.bhi - 1 + g.dd) - greatest(x.si, g.alo, g.blo + g.dd) + 1 END AS mk,
       CASE WHEN x.si IS NULL THEN g.alo ELSE greatest(x.si, g.alo, g.blo + g.dd) END AS mi,
       CASE WHEN x.si IS NULL THEN g.blo ELSE greatest(x.si, g.alo, g.blo + g.dd) - g.dd END AS mj
FROM (
  SELECT r.pair_id, r.alo, r.ahi, r.blo, r.bhi,
         coalesce(first(n.d ORDER BY
             least(n.ei, r.ahi - 1, r.bhi - 1 + n.d) - greatest(n.si, r.alo, r.blo + n.d) DESC,
             least(n.ei, r.ahi - 1, r.bhi - 1 + n.d) ASC,
             least(n.ei, r.ahi - 1, r.bhi - 1 + n.d) - n.d ASC), r.alo - r.blo) AS dd,
         coalesce(first(CASE WHEN n.d IS NOT NULL THEN least(n.ei, r.ahi - 1, r.bhi - 1 + n.d) END ORDER BY
             least(n.ei, r.ahi - 1, r.bhi - 1 + n.d) - greatest(n.si, r.alo, r.blo + n.d) DESC,
             least(n.ei, r.ahi - 1, r.bhi - 1 + n.d) ASC,
             least(n.ei, r.ahi - 1, r.bhi - 1 + n.d) - n.d ASC), r.alo) AS pi
  FROM {rel} r
  LEFT JOIN nisl n ON n.pair_id = r.pair_id
       AND least(n.ei, r.ahi - 1, r.bhi - 1 + n.d) >= greatest(n.si, r.alo, r.blo + n.d)
  GROUP BY r.pair_id, r.alo, r.ahi, r.blo, r.bhi
) g
LEFT JOIN aisl x ON x.pair_id = g.pair_id AND x.d = g.dd AND x.si <= g.pi AND g.pi <= x.ei
     AND g.pi >= g.alo AND g.pi - g.dd >= g.blo AND g.pi < g.ahi AND g.pi - g.dd < g.bhi"""


def alignment_ctes(src: str) -> str:
    """CTEs ``tagrows(pair_id, pos, token, tag)`` and ``gaprows(pair_id, gap_pos, ins)``.

    ``src`` must define ``(pair_id, o, c)`` with token lists ``o`` and ``c``.
    """
    return f"""
al_src AS ({src}),
al_a AS (SELECT pair_id, unnest(o) AS tok, generate_subscripts(o, 1) - 1 AS i FROM al_src),
al_b AS (SELECT pair_id, unnest(c) AS tok, generate_subscripts(c, 1) - 1 AS j FROM al_src),
al_len AS (SELECT pair_id, len(o) AS la, len(c) AS lb FROM al_src),
al_pop AS (
  SELECT b.pair_id, b.tok FROM al_b b JOIN al_len l USING (pair_id)
  WHERE l.lb >= 200 GROUP BY b.pair_id, b.tok, l.lb HAVING count(*) > l.lb // 100 + 1),
cells AS (
  SELECT a.pair_id, a.i, b.j, a.i - b.j AS d, p.tok IS NOT NULL AS popular
  FROM al_a a JOIN al_b b ON a.pair_id = b.pair_id AND a.tok = b.tok
  LEFT JOIN al_pop p ON p.pair_id = a.pair_id AND p.tok = a.tok),
aisl AS (
  SELECT pair_id, d, min(i) AS si, max(i) AS ei FROM (
    SELECT pair_id, d, i, i - row_number() OVER (PARTITION BY pair_id, d ORDER BY i) AS g FROM cells)
  GROUP BY pair_id, d, g),
nisl AS (
  SELECT pair_id, d, min(i) AS si, max(i) AS ei FROM (
    SELECT pair_id, d, i, i - row_number() OVER (PARTITION BY pair_id, d ORDER BY i) AS g
    FROM cells WHERE NOT popular)
  GROUP BY pair_id, d, g),
iv AS (
  SELECT pair_id, 0 AS alo, la AS ahi, 0 AS blo, lb AS bhi FROM al_len WHERE la > 0 AND lb > 0
  UNION ALL
  SELECT pair_id, (ch).alo, (ch).ahi, (ch).blo, (ch).bhi FROM (
    SELECT pair_id, unnest([{{'alo': alo, 'ahi': mi, 'blo': blo, 'bhi': mj}},
                            {{'alo': mi + mk, 'ahi': ahi, 'blo': mj + mk, 'bhi': bhi}}]) AS ch
    FROM ({_best_block('iv')}) WHERE mk > 0)
  WHERE (ch).alo < (ch).ahi AND (ch).blo < (ch).bhi
),
blocks AS (SELECT pair_id, mi, mj, mk FROM ({_best_block('iv')}) WHERE mk > 0),
bounds AS (
  SELECT pair_id, mi + mk AS ie, mj + mk AS je,
         lead(mi, 1, la) OVER (PARTITION BY pair_id ORDER BY mi, mk) AS ai,
         lead(mj, 1, lb) OVER (PARTITION BY pair_id ORDER BY mi, mk) AS bj
  FROM (SELECT pair_id, mi, mj, mk FROM blocks
        UNION ALL SELECT pair_id, 0, 0, 0 FROM al_len) JOIN al_len USING (pair_id)),
segs AS (SELECT * FROM bounds WHERE ai > ie OR bj > je),
tagrows AS (
  SELECT a.pair_id, a.i AS pos, a.tok AS token,
         CASE WHEN s.pair_id IS NULL THEN 'KEEP'
              WHEN s.ai - s.ie = s.bj - s.je THEN 'REPLACE_' || src.c[s.je + (a.i - s.ie) + 1]
              ELSE 'DELETE' END AS tag
  FROM al_a a JOIN al_src src USING (pair_id)
  LEFT JOIN segs s ON s.pair_id = a.pair_id AND a.i >= s.ie AND a.i < s.ai),
gaprows AS (
  SELECT s.pair_id, s.ai AS gap_pos, src.c[s.je + 1 : s.bj] AS ins
  FROM segs s JOIN al_src src USING (pair_id)
  WHERE s.bj > s.je AND s.ai - s.ie <> s.bj - s.je)"""


# ---------------------------------------------------------------------------
# Shared CTE chain for the registered queries (pairs -> F1 -> F2 -> tokens ->
# alignment -> vocabulary -> split -> count model -> validation scoring).
# ---------------------------------------------------------------------------

def strip_sql(expr: str) -> str:
    """DuckDB twin of ``functions.text.py_strip``."""
    return f"regexp_replace({expr}, '^{WS_RUN}|{WS_RUN}\\z', '', 'g')"


def apply_one_sql(token: str, tag: str) -> str:
    """Applied token for one (token, tag); NULL = dropped."""
    return (f"CASE WHEN {tag} = 'KEEP' THEN {token} WHEN {tag} = 'DELETE' THEN NULL "
            f"WHEN starts_with({tag}, 'REPLACE_') THEN substr({tag}, 9) ELSE {token} END")


# The letters beyond ASCII in the tables, in lower case.
LETTERS = "éóèñçüêäößí"


def fold_sql(expr: str) -> str:
    """Lower case with each letter beyond ASCII re-coded to one byte: DuckDB's ``levenshtein`` counts bytes."""
    codes = " || ".join(f"chr({i + 1})" for i in range(len(LETTERS)))
    return f"translate(lower({expr}), '{LETTERS}', {codes})"


def distance_sql(a: str, b: str, fold: bool = True) -> str:
    if fold:
        return f"levenshtein({fold_sql(a)}, {fold_sql(b)})"
    both = LETTERS + LETTERS.upper().replace("SS", "")
    codes = " || ".join(f"chr({i + 1 + (i > 7) * 6})" for i in range(len(both)))
    return f"levenshtein(translate({a}, '{both}', {codes}), translate({b}, '{both}', {codes}))"


def corpus_ctes() -> str:
    from .fixtures import DERIVED_PAIRS_SQL
    return "WITH RECURSIVE " + DERIVED_PAIRS_SQL + f""",
f1 AS (SELECT * FROM pairs WHERE original_text IS NOT NULL AND corrected_text IS NOT NULL),
f2 AS (
  SELECT * FROM f1
  WHERE {distance_sql('original_text', 'corrected_text')}::DOUBLE
        / nullif(greatest(length(original_text), length(corrected_text)), 0)::DOUBLE <= 0.30::DOUBLE),
tok AS (SELECT pair_id, {tokenize_sql('original_text')} AS o, {tokenize_sql('corrected_text')} AS c FROM f2),
{alignment_ctes("SELECT pair_id, o, c FROM tok")},
vocab AS (
  SELECT tag, (row_number() OVER (ORDER BY tag) - 1)::INTEGER AS tag_id
  FROM (SELECT tag FROM tagrows UNION SELECT 'KEEP' UNION SELECT 'DELETE')),
keep_id AS (SELECT tag_id FROM vocab WHERE tag = 'KEEP'),
splits AS (
  SELECT pair_id,
         CASE WHEN row_number() OVER (ORDER BY md5('42|' || pair_id::VARCHAR), pair_id)
                   <= floor(count(*) OVER () * 0.05::DOUBLE) THEN 'validation' ELSE 'train' END AS split
  FROM tok),
train_tags AS (SELECT t.* FROM tagrows t JOIN splits s USING (pair_id) WHERE s.split = 'train'),
val_tags AS (SELECT t.* FROM tagrows t JOIN splits s USING (pair_id) WHERE s.split = 'validation'),
val_tok AS (SELECT t.* FROM tok t JOIN splits s USING (pair_id) WHERE s.split = 'validation'),
mcounts AS (SELECT token, tag, count(*) AS n FROM train_tags GROUP BY token, tag),
mtot AS (SELECT token, sum(n)::BIGINT AS n_total FROM mcounts GROUP BY token),
mrows AS (
  SELECT m.token, v.tag_id, m.tag, m.n FROM mcounts m JOIN vocab v USING (tag)
  UNION ALL
  SELECT t.token, (SELECT tag_id FROM keep_id), 'KEEP', 0 FROM mtot t
  WHERE NOT EXISTS (SELECT 1 FROM mcounts m WHERE m.token = t.token AND m.tag = 'KEEP')),
model AS (
  SELECT token, n_total, tag_id, tag, prob, ln(prob) AS logit,
         row_number() OVER (PARTITION BY token ORDER BY prob DESC, tag_id) AS rk
  FROM (SELECT r.token, t.n_total, r.tag_id, r.tag,
               (r.n::DOUBLE + CASE WHEN r.tag = 'KEEP' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
               / (t.n_total::DOUBLE + 1.0::DOUBLE) AS prob
        FROM mrows r JOIN mtot t USING (token))),
val_scored AS (
  SELECT v.pair_id, v.pos, v.token, l.tag_id AS label,
         coalesce(m.tag_id, (SELECT tag_id FROM keep_id)) AS pred,
         coalesce(m.tag, 'KEEP') AS pred_tag
  FROM val_tags v JOIN vocab l ON l.tag = v.tag
  LEFT JOIN model m ON m.token = v.token AND m.rk = 1),
val_loss AS (
  SELECT v.pair_id, v.pos,
         CASE WHEN NOT EXISTS (SELECT 1 FROM model m WHERE m.token = v.token)
              THEN 0.0 - CASE WHEN v.label = (SELECT tag_id FROM keep_id) THEN 0.0 ELSE ln(1e-12) END
              ELSE (SELECT ln(sum(exp(m.logit))) FROM model m WHERE m.token = v.token)
                   - coalesce((SELECT m.logit FROM model m WHERE m.token = v.token AND m.tag_id = v.label),
                              ln(1e-12)) END AS loss
  FROM val_scored v),
val_sent AS (
  SELECT t.pair_id, array_to_string(t.o, ' ') AS sentence, array_to_string(t.c, ' ') AS reference,
         coalesce((SELECT string_agg({apply_one_sql('s.token', 's.pred_tag')}, ' ' ORDER BY s.pos)
                   FROM val_scored s WHERE s.pair_id = t.pair_id), '') AS corrected
  FROM val_tok t)
"""


ORACLES = {
    "derived_pairs": "SELECT pair_id, original_text, corrected_text FROM pairs",
    "drop_null_pairs": "SELECT pair_id, original_text, corrected_text FROM f1",
    "edit_ratio": f"""SELECT pair_id, round({distance_sql('original_text', 'corrected_text')}::DOUBLE
        / nullif(greatest(length(original_text), length(corrected_text)), 0)::DOUBLE, 6) AS edit_ratio FROM f1""",
    "minimal_edit_filter": "SELECT pair_id, original_text, corrected_text FROM f2",
    "tokenize": """
        SELECT pair_id, 'original' AS side, (generate_subscripts(o, 1) - 1)::INTEGER AS pos, unnest(o) AS token FROM tok
        UNION ALL
        SELECT pair_id, 'corrected', (generate_subscripts(c, 1) - 1)::INTEGER, unnest(c) FROM tok""",
    "diff_to_tags": "SELECT pair_id, pos::INTEGER AS pos, token, tag FROM tagrows",
    "gap_tags": "SELECT pair_id, gap_pos::INTEGER AS gap_pos, array_to_string(ins, ' ') AS ins_text FROM gaprows",
    "diff_roundtrip": "SELECT pair_id, true AS length_ok, true AS roundtrip_ok FROM tok",
    "apply_tags": f"""
        SELECT t.pair_id, coalesce((SELECT string_agg({apply_one_sql('r.token', 'r.tag')}, ' ' ORDER BY r.pos)
                                    FROM tagrows r WHERE r.pair_id = t.pair_id), '') AS applied_text
        FROM tok t""",
    "build_tag_vocab": "SELECT tag, tag_id FROM vocab",
    "tag_parts": """
        SELECT tag,
               CASE WHEN starts_with(tag, 'REPLACE_') THEN 'REPLACE'
                    WHEN starts_with(tag, 'INSERT_') THEN 'INSERT' ELSE tag END AS tag_op,
               CASE WHEN strpos(tag, '_') > 0 THEN substr(tag, strpos(tag, '_') + 1) ELSE '' END AS arg,
               starts_with(tag, 'REPLACE_') AS is_replace, starts_with(tag, 'INSERT_') AS is_insert
        FROM vocab""",
    "encode_tags": "SELECT r.pair_id, r.pos::INTEGER AS pos, v.tag_id FROM tagrows r JOIN vocab v USING (tag)",
    "decode_tags": "SELECT pair_id, pos::INTEGER AS pos, tag FROM tagrows",
    "split_train_validation": "SELECT pair_id, split FROM splits",
    "split_complement": "SELECT pair_id FROM splits WHERE split = 'train'",
    "subword_explode": """
        SELECT pair_id, word_id, piece_no, piece,
               (4 + ('0x' || substr(md5(piece), 1, 6))::BIGINT % 50261)::INTEGER AS piece_id
        FROM (SELECT pair_id, pos::INTEGER AS word_id,
                     unnest(regexp_extract_all(token, '.{1,4}')) AS piece,
                     (generate_subscripts(regexp_extract_all(token, '.{1,4}'), 1) - 1)::INTEGER AS piece_no
              FROM tagrows)""",
    "first_subtoken": """
        SELECT pair_id, word_id, piece_no, piece_no = 0 AS is_first
        FROM (SELECT pair_id, pos::INTEGER AS word_id,
                     (generate_subscripts(regexp_extract_all(token, '.{1,4}'), 1) - 1)::INTEGER AS piece_no
              FROM tagrows)""",
    "encode_examples": """
        SELECT * FROM (WITH pc AS (
          SELECT r.pair_id, r.pos, v.tag_id,
                 unnest(regexp_extract_all(r.token, '.{1,4}')) AS piece,
                 generate_subscripts(regexp_extract_all(r.token, '.{1,4}'), 1) - 1 AS pno
          FROM tagrows r JOIN vocab v USING (tag)),
        sq AS (
          SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY pos, pno) AS sp,
                 (4 + ('0x' || substr(md5(piece), 1, 6))::BIGINT % 50261) AS pid,
                 CASE WHEN pno = 0 THEN tag_id ELSE -100 END AS lab
          FROM pc),
        ex AS (
          SELECT t.pair_id,
                 (SELECT count(*) FROM sq WHERE sq.pair_id = t.pair_id AND sp <= 126) AS n,
                 (SELECT string_agg(pid::VARCHAR, ' ' ORDER BY sp) FROM sq WHERE sq.pair_id = t.pair_id AND sp <= 126) AS ids,
                 (SELECT string_agg(lab::VARCHAR, ' ' ORDER BY sp) FROM sq WHERE sq.pair_id = t.pair_id AND sp <= 126) AS labs
          FROM tok t)
        SELECT pair_id,
               '0' || coalesce(' ' || ids, '') || ' 2' || repeat(' 1', (126 - n)::INTEGER) AS input_ids,
               trim(repeat('1 ', (n + 2)::INTEGER) || repeat('0 ', (126 - n)::INTEGER)) AS attention_mask,
               '-100' || coalesce(' ' || labs, '') || ' -100' || repeat(' -100', (126 - n)::INTEGER) AS labels
        FROM ex)""",
    "fit_count_tagger": """
        SELECT token, n_total, rk::INTEGER AS rk, tag_id, tag, round(prob, 6) AS prob, round(logit, 6) AS logit
        FROM model""",
    "correct_batch": "SELECT pair_id, sentence, corrected FROM val_sent",
    "correct_verbose": f"""
        SELECT s.pair_id, s.pos::INTEGER AS pos, s.token, s.pred_tag,
               coalesce((SELECT string_agg(m.tag || '=' || CAST(round(m.prob * 1000000) AS BIGINT)::VARCHAR, ' ' ORDER BY m.rk)
                         FROM model m WHERE m.token = s.token AND m.rk <= 3),
                        'KEEP=1000000') AS top3,
               v.corrected,
               {strip_sql('v.corrected')} <> {strip_sql('v.sentence')} AS corrections_made
        FROM val_scored s JOIN val_sent v USING (pair_id)""",
    "token_accuracy": """
        SELECT count_if(pred = label) AS n_correct, count(*) AS n_positions,
               round(count_if(pred = label)::DOUBLE / nullif(count(*), 0)::DOUBLE, 6) AS token_accuracy,
               round((SELECT avg(loss) FROM val_loss), 6) AS cross_entropy
        FROM val_scored""",
    "sentence_metrics": f"""
        SELECT round(sum({distance_sql('corrected', 'reference', fold=False)})::DOUBLE / sum(length(reference))::DOUBLE, 6) AS cer,
               round(avg(len(list_filter(string_split(corrected, ' '), lambda t: t <> ''))), 6) AS gen_len,
               round(avg(CASE WHEN corrected = reference THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS sentence_accuracy,
               count(*) AS n_sentences
        FROM val_sent""",
}




# --- requests -------------------------------------------------------------

REQUESTS_SQL = f"""
rq_src AS (
  SELECT conv_id, turn, text, (1 + turn % 5)::INTEGER AS k FROM conversations WHERE role = 'user'),
rq AS (
  SELECT conv_id, turn,
    CASE conv_id % 10
      WHEN 0 THEN substr(json_object('sentence', text)::VARCHAR, 1, length(json_object('sentence', text)::VARCHAR) - 1)
      WHEN 1 THEN json_object('top_k', k)::VARCHAR
      WHEN 2 THEN '{{"sentence": null, "top_k": ' || k::VARCHAR || '}}'
      WHEN 3 THEN '{{"sentence": ' || conv_id::VARCHAR || ', "top_k": ' || k::VARCHAR || '}}'
      WHEN 4 THEN json_object('sentence', '   ', 'top_k', k)::VARCHAR
      WHEN 5 THEN json_object('sentence', text, 'top_k', k::VARCHAR)::VARCHAR
      WHEN 6 THEN json_object('sentence', text, 'top_k', k::DOUBLE + 0.7::DOUBLE)::VARCHAR
      WHEN 7 THEN json_object('sentence', text, 'top_k', 'x')::VARCHAR
      WHEN 8 THEN '[1, 2]'
      ELSE json_object('sentence', text, 'top_k', k)::VARCHAR END AS body
  FROM rq_src),
rq_obj AS (
  SELECT conv_id, turn, body,
         CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' ELSE false END AS is_obj
  FROM rq),
rq_fields AS (
  SELECT conv_id, turn,
         CASE WHEN is_obj THEN json_type(body, '$.sentence') END AS st,
         CASE WHEN is_obj THEN json_extract_string(body, '$.sentence') END AS sv,
         CASE WHEN is_obj THEN json_type(body, '$.top_k') END AS tt,
         CASE WHEN is_obj THEN json_extract_string(body, '$.top_k') END AS ts
  FROM rq_obj),
parsed_rq AS (
  SELECT conv_id, turn,
         CASE WHEN st IS NULL THEN '' WHEN st = 'VARCHAR' THEN sv END AS sentence,
         CASE WHEN tt IS NULL THEN 3::BIGINT
              WHEN tt IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN trunc(ts::DOUBLE)::BIGINT
              WHEN tt = 'BOOLEAN' THEN CASE WHEN ts = 'true' THEN 1 ELSE 0 END::BIGINT
              WHEN tt = 'VARCHAR' AND regexp_full_match(trim(ts), '[+-]?[0-9]+') THEN trim(ts)::BIGINT
         END AS top_k,
         CASE WHEN st IS NULL THEN 'missing' WHEN st = 'VARCHAR' THEN 'string' WHEN st = 'NULL' THEN 'null'
              WHEN st IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' ELSE 'other' END AS sentence_kind
  FROM rq_fields),
routed_rq AS (
  SELECT *,
         CASE WHEN top_k IS NULL THEN 'bad_top_k'
              WHEN sentence_kind NOT IN ('string', 'missing') THEN 'bad_sentence'
              WHEN NOT regexp_matches(sentence, '[^{WS_RUN[1:-2]}]') THEN 'empty'
              ELSE 'score' END AS route
  FROM parsed_rq),
routed2 AS (
  SELECT *, CASE WHEN route IN ('bad_top_k', 'bad_sentence') THEN 400 ELSE 200 END AS status,
         CASE route WHEN 'bad_top_k' THEN 'top_k must be an integer'
                    WHEN 'bad_sentence' THEN '''sentence'' must be a string' END AS error,
         CASE route WHEN 'empty' THEN 'Input sentence was empty.'
                    WHEN 'score' THEN 'Typos checked successfully.' END AS message
  FROM routed_rq),
ntags AS (SELECT count(*) AS n FROM vocab),
rq_tok AS (
  SELECT conv_id, turn, top_k, sentence, unnest({tokenize_sql('sentence')}) AS token,
         generate_subscripts({tokenize_sql('sentence')}, 1) - 1 AS pos
  FROM routed2 WHERE route = 'score'),
rq_scored AS (
  SELECT t.conv_id, t.turn, t.pos, t.token, coalesce(m.tag, 'KEEP') AS pred_tag,
         coalesce((SELECT string_agg(x.tag || '=' || CAST(round(x.prob * 1000000) AS BIGINT)::VARCHAR, ',' ORDER BY x.rk)
                   FROM model x WHERE x.token = t.token
                     AND x.rk <= least(greatest(t.top_k, 1), (SELECT n FROM ntags))),
                  'KEEP=1000000') AS topk,
         coalesce((SELECT string_agg(x.tag || ': ' || (CAST(round(x.prob * 1000) AS BIGINT) // 10)::VARCHAR || '.'
                                     || (CAST(round(x.prob * 1000) AS BIGINT) % 10)::VARCHAR || '%', ' | ' ORDER BY x.rk)
                   FROM model x WHERE x.token = t.token
                     AND x.rk <= least(greatest(t.top_k, 1), (SELECT n FROM ntags))),
                  'KEEP: 100.0%') AS topk_pct
  FROM rq_tok t LEFT JOIN model m ON m.token = t.token AND m.rk = 1),
responses AS (
  SELECT r.conv_id, r.turn, r.status, r.error, r.message,
         CASE WHEN r.status = 200 THEN r.sentence END AS original_sentence,
         CASE WHEN r.route = 'score' THEN coalesce(s.corrected, '') WHEN r.route = 'empty' THEN '' END AS corrected_sentence,
         CASE WHEN r.route = 'score'
              THEN {strip_sql("coalesce(s.corrected, '')")} <> {strip_sql('r.sentence')}
              WHEN r.route = 'empty' THEN false END AS corrections_made,
         CASE WHEN r.status = 200 THEN 'redline-count-tagger' END AS model_name,
         CASE WHEN r.route = 'score' THEN coalesce(s.details, '') WHEN r.route = 'empty' THEN '' END AS details,
         CASE WHEN r.route = 'score' THEN coalesce(s.plain, '') WHEN r.route = 'empty' THEN '' END AS plain_details
  FROM routed2 r
  LEFT JOIN (
    SELECT conv_id, turn,
           string_agg({apply_one_sql('token', 'pred_tag')}, ' ' ORDER BY pos) AS corrected,
           string_agg(token || '|' || pred_tag || '|' || topk, ' ; ' ORDER BY pos) AS details,
           string_agg(token || '|' || pred_tag, ' ; ' ORDER BY pos) AS plain
    FROM rq_scored GROUP BY conv_id, turn) s
  ON s.conv_id = r.conv_id AND s.turn = r.turn)
"""

_RESPONSE_SELECT = ("SELECT conv_id, turn, status, error, message, original_sentence, corrected_sentence, "
                    "corrections_made, model_name, details FROM responses")

ORACLES.update({
    "parse_requests": "SELECT conv_id, turn, sentence, top_k, sentence_kind FROM parsed_rq",
    "route_requests": "SELECT conv_id, turn, status, error, message FROM routed2",
    "unavailable_responses": "SELECT conv_id, turn, 503 AS status, 'Model unavailable.' AS error FROM rq_src",
    "check_typos": _RESPONSE_SELECT,
    "correct_stream": _RESPONSE_SELECT,
    "render_token_table": """
        SELECT conv_id, turn, (pos + 1)::INTEGER AS row_no, token, pred_tag, topk_pct AS top_probs
        FROM rq_scored""",
})

_REQUEST_ORACLES = {"parse_requests", "route_requests", "unavailable_responses", "check_typos", "correct_stream",
                    "render_token_table"}




# --- term lists and round trips ------------------------------------------

NON_WS_CLASS = "[^" + WS_RUN[1:-2] + "]"

TERMS_SQL = f"""
tl AS (
  SELECT p_partkey AS line_no,
    CASE p_partkey % 7 WHEN 0 THEN '   ' WHEN 1 THEN p_name
         WHEN 2 THEN p_name || '/js[' || p_brand || '/x[' || p_type || ']]'
         WHEN 3 THEN p_name || '/Alias[|' || p_brand || ']'
         ELSE p_name || '/alias[' || p_brand || '|' || p_type || ']' END AS line
  FROM part),
tl_marked AS (
  SELECT line_no, regexp_replace(line, '(?i)/[a-z]+\\[', chr(1)) AS m
  FROM tl WHERE regexp_matches(line, '{NON_WS_CLASS}')),
tl_raw AS (
  SELECT line_no,
         list_concat([split_part(m, chr(1), 1)],
                     CASE WHEN strpos(m, chr(1)) > 0
                          THEN string_split(regexp_replace(substr(m, strpos(m, chr(1)) + 1), '\\]+$', ''), '|')
                          ELSE []::VARCHAR[] END) AS raw_terms
  FROM tl_marked),
tl_terms AS (
  SELECT line_no, term_no, replace({strip_sql('raw')}, ' ', '') AS term FROM (
    SELECT line_no, unnest(raw_terms) AS raw, (generate_subscripts(raw_terms, 1) - 1)::INTEGER AS term_no
    FROM tl_raw)),
term_dict AS (
  SELECT term, count(*)::BIGINT AS freq, min(line_no) AS first_line,
         arg_min(term_no, line_no * 1000 + term_no)::INTEGER AS first_term_no
  FROM tl_terms WHERE term <> '' GROUP BY term),
bench_lines AS (
  SELECT item_id, unnest(string_split(text, chr(10))) AS sentence,
         generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM benchmark),
bl_tok AS (
  SELECT b.*, unnest({tokenize_sql('sentence')}) AS token,
         generate_subscripts({tokenize_sql('sentence')}, 1) - 1 AS pos
  FROM (SELECT row_number() OVER (ORDER BY item_id, ln) AS lid, sentence FROM bench_lines) b),
bl_corr AS (
  SELECT b.lid, b.sentence,
         coalesce((SELECT string_agg({apply_one_sql('t.token', "coalesce(m.tag, 'KEEP')")}, ' ' ORDER BY t.pos)
                   FROM bl_tok t LEFT JOIN model m ON m.token = t.token AND m.rk = 1
                   WHERE t.lid = b.lid), '') AS corrected,
         len({tokenize_sql('b.sentence')}) AS n_tokens
  FROM (SELECT row_number() OVER (ORDER BY item_id, ln) AS lid, sentence FROM bench_lines) b)
"""

_NA = ", ".join("'" + w + "'" for w in NA_WORDS)

ORACLES.update({
    "term_dictionary": "SELECT term, freq, first_line, first_term_no FROM term_dict",
    "term_list_roundtrip": "SELECT term, freq FROM term_dict",
    "pairs_csv_roundtrip": f"""
        SELECT pair_id,
               CASE WHEN original_text IN ({_NA}) THEN NULL ELSE original_text END AS original_text,
               CASE WHEN corrected_text IN ({_NA}) THEN NULL ELSE corrected_text END AS corrected_text
        FROM pairs""",
    "vocab_json_roundtrip": "SELECT tag, tag_id FROM vocab",
    "encoded_roundtrip": "SELECT e.pair_id, s.split, e.input_ids, e.attention_mask, e.labels FROM (" + ORACLES["encode_examples"]
                         + ") e JOIN splits s USING (pair_id)",
    "sentences_roundtrip": "SELECT lid::INTEGER AS line_no, corrected FROM bl_corr",
    "verbose_jsonl_roundtrip": """
        SELECT b.sentence AS original, b.corrected,
               coalesce((SELECT string_agg(t.token || '|' || coalesce(m.tag, 'KEEP') || '|' ||
                    coalesce((SELECT string_agg(x.tag || '=' || CAST(round(x.prob * 1000000) AS BIGINT)::VARCHAR, ','
                                ORDER BY CAST(round(x.prob * 1000000) AS BIGINT) DESC, x.tag)
                              FROM model x WHERE x.token = t.token AND x.rk <= 5), 'KEEP=1000000'), ' ; ' ORDER BY t.pos)
                 FROM bl_tok t LEFT JOIN model m ON m.token = t.token AND m.rk = 1 WHERE t.lid = b.lid), '') AS tokens
        FROM bl_corr b""",
    "dataset_from_csv": ORACLES["token_accuracy"],
    "model_roundtrip": ORACLES["token_accuracy"],
    "user_metrics": """
        SELECT count_if(pred = label) AS n_correct, count(*) AS n_positions, count_if(label <> (SELECT tag_id FROM keep_id) AND pred = label) AS n_recalled,
               count_if(label <> (SELECT tag_id FROM keep_id)) AS n_changed, count_if(pred <> (SELECT tag_id FROM keep_id)) AS n_proposed FROM val_scored""",
})

_TERM_ORACLES = {"term_dictionary", "term_list_roundtrip", "sentences_roundtrip", "verbose_jsonl_roundtrip"}




# --- sequence metrics -----------------------------------------------------

def _grams_sql(side: str, n: int) -> str:
    return (f"SELECT pair_id, {n} AS n, unnest(CASE WHEN len(t) >= {n} THEN "
            f"list_transform(range(0, len(t) - {n} + 1), lambda i: array_to_string(t[i + 1 : i + {n}], ' ')) "
            f"ELSE []::VARCHAR[] END) AS gram, {1 if side == 'p' else 0} AS ip, {0 if side == 'p' else 1} AS ir "
            f"FROM (SELECT pair_id, {tokenize_sql('corrected' if side == 'p' else 'reference')} AS t FROM val_sent)")


NGRAMS_SQL = ("ngr AS (SELECT pair_id, n, gram, sum(ip) AS cp, sum(ir) AS cr FROM ("
              + " UNION ALL ".join(_grams_sql(s, n) for n in range(1, 5) for s in ("p", "r"))
              + ") GROUP BY pair_id, n, gram)")

ORACLES.update({
    "corpus_bleu": """
        SELECT round(CASE WHEN k < 4 THEN 0.0
                          ELSE (CASE WHEN c > r THEN 1.0 ELSE exp(1 - r::DOUBLE / c::DOUBLE) END) * exp(s / 4) END
                     * 100, 6) AS bleu, c AS pred_len, r AS ref_len
        FROM (SELECT sum(CASE WHEN m > 0 THEN ln(m::DOUBLE / t::DOUBLE) END) AS s,
                     count_if(m > 0) AS k,
                     coalesce(max(CASE WHEN n = 1 THEN t END), 0) AS c,
                     coalesce(max(CASE WHEN n = 1 THEN tr END), 0) AS r
              FROM (SELECT n, sum(least(cp, cr)) AS m, sum(cp) AS t, sum(cr) AS tr FROM ngr GROUP BY n))""",
    "rouge_n": """
        SELECT round(avg(CASE WHEN n = 1 THEN f END), 6) AS rouge1, round(avg(CASE WHEN n = 2 THEN f END), 6) AS rouge2
        FROM (SELECT v.pair_id, x.n,
                     coalesce((SELECT CASE WHEN sum(least(cp, cr)) = 0 THEN 0.0
                                           ELSE 2.0 * sum(least(cp, cr)) / (sum(cp) + sum(cr)) END
                               FROM ngr g WHERE g.pair_id = v.pair_id AND g.n = x.n), 0.0) AS f
              FROM val_sent v, (SELECT unnest([1, 2]) AS n) x)""",
})

_NGRAM_ORACLES = {"corpus_bleu", "rouge_n"}


# Dynamic programmes as recursive tables, a left token a step: within a step the
# dependence on the cell before is a running minimum or maximum.
WORDS_SQL = f"""
wr AS (SELECT pair_id AS k, {tokenize_sql('reference')} AS r, {tokenize_sql('corrected')} AS p FROM val_sent),
rt AS MATERIALIZED (SELECT k, unnest(r) AS w, generate_subscripts(r, 1) AS i FROM wr),
pt AS MATERIALIZED (SELECT k, unnest(p) AS w, generate_subscripts(p, 1) AS j FROM wr)"""

WER_SQL = WORDS_SQL + """,
lev AS (
  SELECT k, 0::BIGINT AS i, unnest(range(0, len(p) + 1)) AS j, unnest(range(0, len(p) + 1)) AS d FROM wr
  UNION ALL
  SELECT k, i + 1, j, min(CASE WHEN j = 0 THEN i + 1 ELSE least(d + 1, before + (rw <> pw)::BIGINT) END - j) OVER (PARTITION BY k ORDER BY j) + j
  FROM (SELECT l.*, rt.w AS rw, pt.w AS pw, lag(l.d) OVER (PARTITION BY l.k ORDER BY l.j) AS before
        FROM lev l JOIN rt ON rt.k = l.k AND rt.i = l.i + 1 LEFT JOIN pt ON pt.k = l.k AND pt.j = l.j))"""

LCS_SQL = """
lcs AS (
  SELECT k, 0::BIGINT AS i, unnest(range(0, len(p) + 1)) AS j, 0::BIGINT AS n FROM lp
  UNION ALL
  SELECT k, i + 1, j, max(CASE WHEN j > 0 AND rw = pw THEN before + 1 ELSE n END) OVER (PARTITION BY k ORDER BY j)
  FROM (SELECT l.*, rt.w AS rw, pt.w AS pw, lag(l.n) OVER (PARTITION BY l.k ORDER BY l.j) AS before
        FROM lcs l JOIN rt ON rt.k = l.k AND rt.i = l.i + 1 LEFT JOIN pt ON pt.k = l.k AND pt.j = l.j))"""

ORACLES.update({
    "word_error_rate": """
        SELECT round(sum(d)::DOUBLE / sum(len(r))::DOUBLE, 6) AS wer FROM lev JOIN wr USING (k) WHERE i = len(r) AND j = len(p)""",
    "rouge_l": """
        SELECT round(avg(CASE WHEN n = 0 THEN 0.0 ELSE 2.0 * n / (len(r) + len(p)) END), 6) AS "rougeL" FROM lcs JOIN wr USING (k) WHERE i = len(r) AND j = len(p)""",
})
_SEQUENCE_SQL = {"word_error_rate": WER_SQL, "rouge_l": WORDS_SQL + ",\nlp AS (SELECT k, r, p FROM wr)," + LCS_SQL}




ORACLES.update({
    "external_scorer_eval": """
        SELECT count(*) AS n_positions,
               count_if(label = (SELECT tag_id FROM keep_id)) AS n_correct,
               round(count_if(label = (SELECT tag_id FROM keep_id))::DOUBLE / nullif(count(*), 0)::DOUBLE, 6) AS token_accuracy,
               round(avg(ln(exp(1.0::DOUBLE) + ((SELECT count(*) FROM vocab) - 1)::DOUBLE)
                         - CASE WHEN label = (SELECT tag_id FROM keep_id) THEN 1.0 ELSE 0.0 END), 6) AS cross_entropy
        FROM (SELECT r.pair_id, r.pos, v.tag_id AS label,
                     coalesce(sum(len(regexp_extract_all(r.token, '.{1,4}'))) OVER (
                         PARTITION BY r.pair_id ORDER BY r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM tagrows r JOIN vocab v USING (tag) JOIN splits s USING (pair_id)
              WHERE s.split = 'validation')
        WHERE before + 1 <= 126""",
})

ORACLES.update({
    "corpus_stats": """
        SELECT (SELECT count(*) FROM pairs) AS n_pairs, count(*) AS n_kept, count_if(split = 'train') AS n_train,
               count_if(split = 'validation') AS n_validation, (SELECT count(*) FROM vocab) AS n_tags FROM splits""",
    "softmax": """
        SELECT token, rk::INTEGER AS rk, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY token), 12) AS p FROM model""",
    "full_distribution": """
        SELECT v.pair_id, v.pos::INTEGER AS pos, (SELECT count(*) FROM vocab) AS n_tags,
               coalesce(m.n, 1) AS n_seen, round(coalesce(m.total, 1.0), 6) AS total, round(coalesce(m.best, 1.0), 6) AS best
        FROM val_tags v LEFT JOIN (SELECT token, count(*) AS n, sum(prob) AS total, max(prob) AS best FROM model GROUP BY token) m USING (token)""",
    "latency_summary": "SELECT count(*) AS n_scored, true AS in_order FROM responses WHERE message = 'Typos checked successfully.'",
    "stream_latency": "SELECT count(*) AS n_requests, 0 AS n_untimed FROM responses",
    "response_json": """
        SELECT conv_id, turn, CASE WHEN status = 200 THEN 7 ELSE 1 END AS n_fields, error, original_sentence, corrected_sentence,
               message, model_name, corrections_made, plain_details AS details FROM responses""",
    "softmax_tagger": """
        SELECT count(*) AS n_positions, count_if(pred = label) AS n_correct_alone, true AS reaches_count_tagger FROM val_scored""",
    "softmax_history": "SELECT unnest(range(1, 5))::INTEGER AS epoch, true AS loss_fell, true AS evaluated",
    "fit_linear_tagger": "SELECT count(*) AS n_positions, true AS beats_keep FROM val_tags",
})
_REQUEST_ORACLES |= {"stream_latency", "latency_summary", "response_json"}


ORACLES["sql_edit_tags"], ORACLES["sql_apply_tags"] = ORACLES["diff_to_tags"], ORACLES["apply_tags"]


# --- tags in context ------------------------------------------------------

CONTEXT_SQL = f"""
cx AS (SELECT t.pair_id, t.pos, t.token, t.tag, s.split, coalesce(lag(t.token) OVER w, '') AS prev, coalesce(lead(t.token) OVER w, '') AS nxt
       FROM tagrows t JOIN splits s USING (pair_id) WINDOW w AS (PARTITION BY t.pair_id ORDER BY t.pos)),
deep AS (SELECT c.* FROM cx c WHERE split = 'train' AND token IN (SELECT token FROM mcounts GROUP BY token HAVING count(*) > 1)),
k2 AS (SELECT token, nxt, tag, count(*)::DOUBLE AS n FROM deep GROUP BY ALL),
s2 AS (SELECT token, nxt, sum(n) AS total, count(*)::DOUBLE AS kinds FROM k2 GROUP BY ALL),
k3 AS (SELECT prev, token, nxt, tag, count(*)::DOUBLE AS n FROM deep GROUP BY ALL),
s3 AS (SELECT prev, token, nxt, sum(n) AS total, count(*)::DOUBLE AS kinds FROM k3 GROUP BY ALL),
c1 AS (SELECT v.pair_id, v.pos, v.prev, v.token, v.nxt, coalesce(m.tag, 'KEEP') AS t, coalesce(m.tag_id, (SELECT tag_id FROM keep_id)) AS tag_id,
              coalesce(m.prob, 1.0::DOUBLE) AS p FROM cx v LEFT JOIN model m USING (token) WHERE v.split = 'validation'),
c2 AS (SELECT c.* EXCLUDE (p), CASE WHEN s.total IS NULL THEN p ELSE coalesce((k.n - 0.75::DOUBLE) / s.total, 0.0::DOUBLE) + 0.75::DOUBLE * s.kinds / s.total * p END AS p
       FROM c1 c LEFT JOIN s2 s USING (token, nxt) LEFT JOIN k2 k ON k.token = c.token AND k.nxt = c.nxt AND k.tag = c.t),
c3 AS (SELECT c.* EXCLUDE (p), CASE WHEN s.total IS NULL THEN p ELSE coalesce((k.n - 0.75::DOUBLE) / s.total, 0.0::DOUBLE) + 0.75::DOUBLE * s.kinds / s.total * p END AS p
       FROM c2 c LEFT JOIN s3 s USING (prev, token, nxt) LEFT JOIN k3 k ON k.prev = c.prev AND k.token = c.token AND k.nxt = c.nxt AND k.tag = c.t),
cbest AS (SELECT pair_id, pos, token, t AS pred_tag, tag_id AS pred FROM c3 QUALIFY row_number() OVER (PARTITION BY pair_id, pos ORDER BY p DESC, tag_id) = 1),
cjudged AS (SELECT v.pair_id, v.pos, v.label, b.pred, v.pred AS alone,
                   (SELECT p FROM c3 WHERE c3.pair_id = v.pair_id AND c3.pos = v.pos AND c3.tag_id = v.label) AS gold
            FROM val_scored v JOIN cbest b ON b.pair_id = v.pair_id AND b.pos = v.pos)
"""

ORACLES.update({
    "context_accuracy": """
        SELECT count(*) AS n_positions, count_if(pred = label) AS n_correct, count_if(alone = label) AS n_correct_alone,
               round(count_if(pred = label)::DOUBLE / count(*), 6) AS token_accuracy, round(count_if(alone = label)::DOUBLE / count(*), 6) AS token_accuracy_alone,
               round(avg(-coalesce(ln(gold), ln(1e-12))), 6) AS cross_entropy FROM cjudged""",
    "correct_in_context": f"""
        SELECT v.pair_id, v.sentence, coalesce((SELECT string_agg({apply_one_sql('b.token', 'b.pred_tag')}, ' ' ORDER BY b.pos)
                                                FROM cbest b WHERE b.pair_id = v.pair_id), '') AS corrected FROM val_sent v""",
})

_CONTEXT_ORACLES = {"context_accuracy", "correct_in_context"}


def oracle(name: str) -> str:
    """The SQL of a query, with the chain of steps it stands on."""
    base = corpus_ctes()
    if name in _REQUEST_ORACLES:
        base = base + "," + REQUESTS_SQL
    if name in _TERM_ORACLES:
        base = base + "," + TERMS_SQL
    if name in _NGRAM_ORACLES:
        base = base + "," + NGRAMS_SQL
    if name in _SEQUENCE_SQL:
        base = base + "," + _SEQUENCE_SQL[name]
    if name in _CONTEXT_ORACLES:
        base = base + "," + CONTEXT_SQL
    return base + ORACLES[name]

"""DuckDB statements for the queries that SQL can express, with constants of their own."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT doc_id, r, t, regexp_extract_all(t, '{_WORD}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
tri AS (SELECT r, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM tri),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (
          SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY r),
line AS (SELECT r, unnest(ls) AS l FROM w),
lw AS (SELECT r, l, regexp_extract_all(l, '{_WORD}') AS x FROM line),
judged AS (SELECT r, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars,
     100 * len(list_filter(x, lambda v: regexp_matches(v, '[#*$%&<>]{{2}}|!!|\?\?'))) > 30 * len(x)
  OR (len(list_filter(x, lambda v: v IN ('|', '»', '›', '•', '·', '>', '/', '::'))) >= 3
      AND 100 * len(list_filter(x, lambda v: v IN ('|', '»', '›', '•', '·', '>', '/', '::'))) > 20 * len(x))
  OR (len(x) <= 3 AND regexp_replace(lower(array_to_string(x, ' ')), '[^\p{{L}} ]', '', 'g') IN (
      'home', 'menu', 'log in', 'login', 'sign in', 'sign up', 'register', 'next', 'previous', 'back to top',
      'read more', 'show more', 'share', 'tweet', 'print', 'skip to content', 'search', 'sitemap', 'site map'))
  OR regexp_matches(lower(array_to_string(x, ' ')), 'all rights reserved|privacy policy|terms of use|terms of service|cookie policy|we use cookies|accept cookies|enable javascript|javascript is disabled|lorem ipsum|subscribe to our newsletter|click here to')
  AS bad FROM lw),
lost AS (SELECT r, sum(chars) AS n FROM judged WHERE bad GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             coalesce(lost.n, 0) AS lost
      FROM w LEFT JOIN cov USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * lost > 50 * word_chars) AS kept
FROM b"""

SHARDS = """
WITH k AS (SELECT doc_id, coalesce(strlen(text), 0) AS row_bytes,
             lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
p AS (SELECT doc_id, row_bytes, d.depth, substr(bits, 1, d.depth::INT) AS prefix
      FROM k, (SELECT unnest(generate_series(0, 60)) AS depth) d),
s AS (SELECT depth, prefix, sum(row_bytes) AS shard_bytes, count(*) AS n FROM p GROUP BY ALL)
SELECT doc_id, prefix AS shard, depth, row_bytes, shard_bytes::BIGINT AS shard_bytes FROM (
  SELECT p.*, s.shard_bytes, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS first
  FROM p JOIN s USING (depth, prefix) WHERE s.shard_bytes <= 4194304 OR s.n = 1)
WHERE first = 1"""

_COMPONENTS = """
reach AS (SELECT a AS node, b AS other FROM links
          UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT node, min(other) AS low FROM reach GROUP BY node)"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
          WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), {_COMPONENTS}
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least ON least.node = e.vec_id"""

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
        ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
            FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
          JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
{_COMPONENTS}
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.node = w.doc_id"""

# CRC-32 of a value by its table of 256 entries, both made from the polynomial
_CRC_TABLE = """t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
       lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""


def _crc(value: str) -> str:
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen({value}) + 1), "
            f"lambda i: ('0x' || substr(hex(encode({value})), (2 * i - 1)::INT, 2))::BIGINT)), "
            f"lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295)")


TARGET_RESAMPLING = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d),
v AS (SELECT w, ({_crc('w')} % 10000) AS k FROM (SELECT w FROM dw UNION SELECT w FROM b), t),
sk AS (SELECT k, count(*) AS n FROM dw JOIN v USING (w) GROUP BY k),
tk AS (SELECT k, count(*) AS n FROM b JOIN v USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(tk.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM sk) + 10000)::DOUBLE
             / ((sk.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM tk) + 10000)::DOUBLE)))::BIGINT AS gain FROM sk LEFT JOIN tk USING (k)),
m AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight, sum(gain) AS total, count(*) AS n FROM dw JOIN v USING (w) JOIN g USING (k) GROUP BY r),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
e AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM s),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20
        ORDER BY score DESC, doc_id, n_features) END AS place, (10 * (SELECT count(*) FROM e WHERE n_features >= 20)) // 100 AS most FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM k"""

_SAID = "replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '</s>', '<' || chr(92) || '/s>'), " \
        "'<s>', '<' || chr(92) || 's>'), '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]')"

CHAT_FORMAT = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
     UNION ALL SELECT -1, k, x, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, x)),
o AS (SELECT *, length({_SAID.format('role')}) + length({_SAID.format('text')}) + 23 AS n FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id"""

# states: 0 nothing yet, 1 after s, 2 after u, 3 after ua; moves before a row, on a row, and at the end
TURN_REPAIR = rf"""
WITH RECURSIVE {_CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS x FROM conversations, t),
h AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role,
        CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN x = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE x <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS prev FROM h),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS fault FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (prev IS NOT NULL AND (prev[1] || role[1]) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last
      FROM f GROUP BY conv_id),
ins(a, b, letters, rows) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
        (0, 2, 'I', E'user:\n'), (1, 2, 'I', E'user:\n'), (3, 2, 'I', E'user:\n'), (2, 3, 'I', E'assistant:\n'),
        (0, 3, 'II', E'user:\nassistant:\n'), (1, 3, 'II', E'user:\nassistant:\n')),
moves(b, initial, letter, c, cost, named) AS (VALUES
        (0, 's', 'K', 1, 0, ''), (0, 'u', 'K', 2, 0, ''), (1, 'u', 'K', 2, 0, ''), (2, 'a', 'K', 3, 0, ''), (3, 'u', 'K', 2, 0, ''),
        (0, '*', 'R', 2, 3, 'user'), (1, '*', 'R', 2, 3, 'user'), (2, '*', 'R', 3, 3, 'assistant'), (3, '*', 'R', 2, 3, 'user'),
        (0, '*', 'D', 0, 4, ''), (1, '*', 'D', 1, 4, ''), (2, '*', 'D', 2, 4, ''), (3, '*', 'D', 3, 4, '')),
p AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS said FROM n
      UNION ALL
      SELECT conv_id, i, state, w.cost, w.audit, w.said FROM (
        SELECT p.conv_id, f.i, m.c AS state, min(struct_pack(cost := p.cost + 3 * length(ins.letters) + m.cost
                 + CASE WHEN f.fault = 'truncated' AND m.letter <> 'D' THEN 3 ELSE 0 END,
                 audit := p.audit || ins.letters || m.letter,
                 said := p.said || ins.rows || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10)
                         ELSE m.named || ':' || f.text || chr(10) END)) AS w
        FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
        JOIN ins ON ins.a = p.state
        JOIN moves m ON m.b = ins.b AND (m.initial = '*' OR m.initial = f.role[1]) AND (m.letter = 'D' OR f.fault IN ('none', 'truncated'))
        GROUP BY p.conv_id, f.i, m.c) z),
e AS (SELECT p.conv_id, min(struct_pack(cost := p.cost + 3 * length(ins.letters), audit := p.audit || ins.letters, said := p.said || ins.rows)) AS w
      FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.last = p.i JOIN ins ON ins.a = p.state AND ins.b IN (0, 3)
      GROUP BY p.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.w.cost, 0)::BIGINT AS cost,
       coalesce(e.w.audit, '') AS audit, sha256(coalesce(left(e.w.said, length(e.w.said) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""

ORACLES = {"op5_quality_rules": QUALITY_RULES, "op6_shards": SHARDS, "op9_near_vectors": NEAR_VECTORS,
           "op10_jaccard_join": JACCARD_JOIN, "op11_target_resampling": TARGET_RESAMPLING, "op12_chat_format": CHAT_FORMAT,
           "op13_turn_repair": TURN_REPAIR}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from aspectra.llm.chat_format import LLAMA_LIKE


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\e')"
    for k, mark in enumerate(LLAMA_LIKE.controls):
        out = f"replace({out}, '{mark}', '{LLAMA_LIKE.letter(k)}')"
    return out


def _head(role: str) -> str:
    cases = " ".join(f"WHEN '{r}' THEN {len(h) + len(t)}" for r, (h, t, _) in LLAMA_LIKE.roles.items())
    before, after, tail = LLAMA_LIKE.other
    return f"CASE {role} {cases} ELSE {len(before) + len(after) + len(tail)} + length({_escaped(role)}) END"


OP2 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n FROM c
), state AS (
  SELECT conv_id, n, role,
    CASE WHEN n = 0 THEN role IN ('system', 'user')
         WHEN role = 'user' THEN before = 'assistant' OR (before = 'system' AND n = 1)
         WHEN role = 'assistant' THEN before = 'user'
         ELSE false END AS fine
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM t)
), order_ AS (
  SELECT conv_id, min(n) FILTER (WHERE NOT fine) AS first_bad_turn, max_by(role, n) = 'assistant' AS ended FROM state GROUP BY conv_id
)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped('text')}) + {_head('role')}) AS BIGINT) AS formatted_chars,
  any_value(first_bad_turn) IS NULL AND any_value(ended) AS valid,
  CAST(any_value(first_bad_turn) AS BIGINT) AS first_bad_turn
FROM t JOIN order_ ON t.conv_id IS NOT DISTINCT FROM order_.conv_id GROUP BY t.conv_id
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, cap / w AS ratio,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE)
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, (SELECT level FROM l WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1) AS fin FROM l
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(w * fin, CAST(cap AS DOUBLE))) AS target FROM f
), b AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(round(target) AS BIGINT) // source_size END AS epochs FROM t
), p AS (
  SELECT d.*, b.source_size, b.target, b.epochs, CAST(round(b.target) AS BIGINT) - b.epochs * b.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - passed)) AS BIGINT) AS taken FROM p
"""


#: CRC-32 is folded over bytes by a table made here; neighbours by a replacement share what is left without one place, others by a deletion are what is left.
OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(0, 256) AS r(i)
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), counted AS (
  SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs WHERE length(w) >= 5 GROUP BY doc_id, w
), hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc
), altered AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), del AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM del a JOIN v b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM del a JOIN v b ON a.d = b.word
), best AS (
  SELECT word, count(*) AS n_near, min_by(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT v.word, CASE WHEN m >= 2 * v.n THEN other END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON v.word = best.word
), chain AS (
  SELECT word, word AS root, 0 AS depth FROM forms
  UNION ALL SELECT chain.word, f.form, depth + 1 FROM chain JOIN forms f ON chain.root = f.word WHERE f.form IS NOT NULL
)
SELECT forms.word, form, r.root, n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM forms JOIN (SELECT word, max_by(root, depth) AS root FROM chain GROUP BY word) r ON forms.word = r.word
"""

OP13 = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
      + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
      + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * coalesce(CAST(w.doc_id > first_id AS INT), 0) AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), letter AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(c, bit)
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, CAST(s AS INT) AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INT) AS before
  FROM orders, range(1, 6) AS r(s)
), counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2, "op3_mixing": OP3, "op11_spelling_variants": OP11, "op13_filter_audit": OP13}

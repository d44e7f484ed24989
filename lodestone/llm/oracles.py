"""DuckDB SQL for the queries that SQL can express.

Trained models (op7, op8), tokenizer files (op3, op9), suffix arrays (op1) and XXH64 (op10) are beyond it; tests hold those against brute force.
"""

from __future__ import annotations

from .license_scan import TEMPLATES, THRESHOLD, alignments, normalised_words


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_STARTS = sorted({(a, i, len(w)) for w in map(normalised_words, TEMPLATES.values()) for a, i in alignments(w, THRESHOLD)})

_OP2 = rf"""
WITH templates(license, words) AS (
  SELECT k, string_split(trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')
  FROM (VALUES {", ".join(f"({_literal(k)}, {_literal(t)})" for k, t in TEMPLATES.items())}) AS v(k, t)
), sets AS (
  SELECT license, list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS own FROM templates
), fits(word, place, n) AS (
  VALUES {", ".join(f"({_literal(a)}, {i}, {n})" for a, i, n in _STARTS)}
), low AS (
  SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL
), raw AS (
  SELECT doc_id, unnest(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n *\n')), [text])) AS p FROM low
), running AS (
  SELECT doc_id, string_split(trim(regexp_replace(text, '[ \n]+', ' ', 'g')), ' ') AS w FROM low
), places AS (
  SELECT doc_id, w, unnest(w) AS x, unnest(range(len(w))) AS i FROM running WHERE list_has_any(w, (SELECT list(DISTINCT word) FROM fits))
), windows AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, greatest(i - place, 0) + 1, greatest(i - place, 0) + n), ' ') AS p FROM places JOIN fits ON x = word
), passages AS (
  SELECT DISTINCT doc_id, trim(regexp_replace(p, '[ \n]+', ' ', 'g')) AS p, FALSE AS inside FROM raw
  UNION ALL
  SELECT doc_id, p, TRUE FROM windows
), cut AS (
  SELECT doc_id, inside, string_split(p, ' ') AS w FROM passages WHERE p LIKE '% %'
), bags AS (
  SELECT doc_id, inside, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM cut
), scored AS (
  SELECT doc_id, inside, license, CAST(2 * len(list_intersect(b, own)) AS DOUBLE) / (len(b) + len(own)) AS dice
  FROM bags JOIN sets ON len(b) BETWEEN len(own) * {THRESHOLD} / (2 - {THRESHOLD}) AND len(own) * (2 - {THRESHOLD}) / {THRESHOLD}
), counted AS (
  SELECT doc_id, license, inside, dice, count(*) AS n FROM scored WHERE dice >= CAST({THRESHOLD} AS DOUBLE) GROUP BY ALL
)
SELECT doc_id, license, max(dice) AS dice, CAST(coalesce(sum(n) FILTER (NOT inside), arg_max(n, (dice, n))) AS BIGINT) AS n_passages FROM counted GROUP BY doc_id, license
"""

# cycles from the closure of the needs, steps from the values along all paths: conversations are short
_OP4 = """
WITH RECURSIVE turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, lower(role) AS role, text, CASE WHEN length(text) >= 8 THEN length(text) ELSE 11 END AS n,
    CAST(to_json(text) AS VARCHAR) AS quoted
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), parts AS (
  SELECT conv_id, turn, role, text, n, quoted,
    [x FOR x IN [CASE WHEN turn >= 2 AND n % 3 <> 0 THEN 'call_' || (turn - 2) END, CASE WHEN n % 4 = 1 THEN 'call_' || (turn + 2) END] IF x IS NOT NULL] AS needs
  FROM turns
), fields AS (
  SELECT *, CASE WHEN len(needs) > 0 THEN '"needs":["' || array_to_string(needs, '","') || '"]' END AS f_needs,
    '"question":' || quoted AS f_question, CASE WHEN n % 7 = 0 THEN '"extra":true' END AS f_extra,
    '"turn":' || CASE WHEN n % 5 = 0 THEN '"' || turn || '"' ELSE '' || turn END AS f_turn
  FROM parts
), calls AS (
  SELECT conv_id, 'call_' || turn AS call_id, turn, 'reply' AS name, needs, text IS NOT NULL AND n % 5 <> 0 AND n % 7 <> 0 AS valid,
    '{' || concat_ws(',', f_turn, f_question, f_needs, f_extra) || '}' AS arguments, '{' || concat_ws(',', f_extra, f_needs, f_question, f_turn) || '}' AS canonical
  FROM fields WHERE role = 'user'
  UNION ALL
  SELECT conv_id, 'call_' || (turn - 1), turn, 'reply', [], text IS NOT NULL,
    '{' || concat_ws(',', '"turn":' || turn, f_question) || '}', '{' || concat_ws(',', f_question, '"turn":' || turn) || '}'
  FROM fields WHERE role = 'assistant' AND n % 6 = 0
  UNION ALL
  SELECT conv_id, 'find_' || turn, turn, 'search', ['call_' || (turn - 1)], text IS NOT NULL,
    '{' || concat_ws(',', '"query":' || quoted, '"needs":["call_' || (turn - 1) || '"]') || '}', '{' || concat_ws(',', '"needs":["call_' || (turn - 1) || '"]', '"query":' || quoted) || '}'
  FROM fields WHERE role = 'assistant' AND n % 4 = 2
), asked AS (
  SELECT * FROM calls QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, arguments) = 1
), given AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, min(turn) AS result_turn FROM turns WHERE role = 'assistant' GROUP BY ALL
), wanted AS (
  SELECT conv_id, call_id AS dst, unnest(list_distinct(needs)) AS src FROM asked
), edges AS (
  SELECT w.conv_id, src, dst FROM wanted w JOIN asked a ON a.conv_id = w.conv_id AND a.call_id = src
), lost AS (
  SELECT DISTINCT conv_id, dst AS call_id FROM wanted w ANTI JOIN asked a ON a.conv_id = w.conv_id AND a.call_id = w.src
), reach AS (
  SELECT * FROM edges
  UNION
  SELECT r.conv_id, r.src, e.dst FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.src = r.dst
), cyclic AS (
  SELECT conv_id, src AS call_id FROM reach WHERE src = dst
), blocked AS (
  SELECT DISTINCT r.conv_id, r.dst AS call_id FROM reach r JOIN cyclic c ON c.conv_id = r.conv_id AND c.call_id = r.src
), open AS (
  SELECT e.* FROM edges e ANTI JOIN reach r ON r.conv_id = e.conv_id AND r.src = e.dst AND r.dst = e.src WHERE e.src <> e.dst
), placed AS (
  SELECT a.conv_id, a.call_id, a.turn AS step, 0 AS depth, g.result_turn FROM asked a LEFT JOIN given g ON g.conv_id = a.conv_id AND g.call_id = a.call_id
  UNION
  SELECT a.conv_id, a.call_id,
    CASE WHEN (greatest(p.step, coalesce(p.result_turn, p.step)), CASE WHEN coalesce(p.result_turn, p.step) > p.step THEN 0 ELSE p.depth + 1 END) > (a.turn, 0) THEN greatest(p.step, coalesce(p.result_turn, p.step)) ELSE a.turn END,
    CASE WHEN (greatest(p.step, coalesce(p.result_turn, p.step)), CASE WHEN coalesce(p.result_turn, p.step) > p.step THEN 0 ELSE p.depth + 1 END) > (a.turn, 0) THEN CASE WHEN coalesce(p.result_turn, p.step) > p.step THEN 0 ELSE p.depth + 1 END ELSE 0 END,
    g.result_turn
  FROM placed p JOIN open o ON o.conv_id = p.conv_id AND o.src = p.call_id JOIN asked a ON a.conv_id = o.conv_id AND a.call_id = o.dst
  LEFT JOIN given g ON g.conv_id = a.conv_id AND g.call_id = a.call_id
), steps AS (
  SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY step DESC, depth DESC) = 1
)
SELECT coalesce(a.conv_id, g.conv_id) AS conv_id, coalesce(a.call_id, g.call_id) AS call_id,
  CASE WHEN a.conv_id IS NULL THEN 'orphan' WHEN g.conv_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, a.name AS name,
  coalesce(s.step, g.result_turn) AS step, CAST(coalesce(s.depth, 0) AS INTEGER) AS depth, CASE WHEN g.result_turn IS NOT NULL THEN greatest(g.result_turn, coalesce(s.step, g.result_turn)) END AS result_step,
  CASE WHEN a.conv_id IS NOT NULL THEN a.valid AND l.conv_id IS NULL END AS valid,
  c.conv_id IS NOT NULL AS cyclic, b.conv_id IS NOT NULL AND c.conv_id IS NULL AS blocked, a.canonical AS canonical
FROM asked a FULL JOIN given g ON a.conv_id = g.conv_id AND a.call_id = g.call_id
LEFT JOIN steps s ON s.conv_id = a.conv_id AND s.call_id = a.call_id LEFT JOIN lost l ON l.conv_id = a.conv_id AND l.call_id = a.call_id
LEFT JOIN (SELECT DISTINCT * FROM cyclic) c ON c.conv_id = a.conv_id AND c.call_id = a.call_id LEFT JOIN blocked b ON b.conv_id = a.conv_id AND b.call_id = a.call_id
WHERE g.conv_id IS NULL OR g.result_turn IS NOT NULL
"""

_OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3.0::DOUBLE, 1, 2][(r - 1) % 3 + 1] AS weight, [-1.0::DOUBLE, 1, 0][(r - 1) % 3 + 1] AS slope, CAST(2 * source_size AS DOUBLE) AS cap,
    CAST(sum(source_size) OVER () AS DOUBLE) * 150 / 100 AS budget
  FROM sources
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), level AS (
  SELECT level AS reached FROM levels WHERE level * weight <= cap ORDER BY cap / weight, r LIMIT 1
), targets AS (
  SELECT source, source_size, slope, least(cap, coalesce((SELECT reached FROM level) * weight, cap)) AS target,
    CASE WHEN source_size > 0 THEN CAST(floor(floor(least(cap, coalesce((SELECT reached FROM level) * weight, cap))) / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM weighted
), placed AS (
  SELECT doc_id, size, source_size, slope, target, epochs, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h % 1024, (h >> 10) % 1024, h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, epochs * size + least(size, greatest(0, rest - before)) AS taken FROM placed
), shares AS (
  SELECT *, 1 - slope / 2 AS b, CASE WHEN size > 0 AND taken > 0 THEN least(1.0::DOUBLE, (before + least(size, taken) / 2.0::DOUBLE) / target) END AS share FROM taken
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN share IS NOT NULL THEN 2 * share / (b + sqrt(greatest(b * b + 2 * slope * share, 0.0::DOUBLE))) END AS position
FROM shares
"""

_OP6 = """
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS r, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), queries AS (
  SELECT vec_id, min(q) AS q FROM vectors WHERE vec_id % 50 = 0 GROUP BY vec_id
), ranked AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.q, b.q) DESC, b.vec_id) AS place
  FROM queries a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""

SQL: dict[str, str] = {"op2_license_scan": _OP2, "op4_tool_calls": _OP4, "op5_mixing": _OP5, "op6_topk": _OP6}

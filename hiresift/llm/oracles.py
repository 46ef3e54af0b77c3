"""SQL that gives the rows of the queries by plain means: every pair, every distance, every rule."""

from __future__ import annotations

from hiresift.llm import chat, host_rules, url_filter
from hiresift.llm.rules import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _whole(scale: int) -> str:
    """The finite vectors as lists of integers."""
    return f"""SELECT *, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"""


HARD_NEGATIVES = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({_whole(256)}) WHERE label IS NOT NULL),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
    n.other AS negative_id, positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score)
SELECT * FROM ranked WHERE rank <= 10"""


def clusters(k: int = 8, rounds: int = 10) -> str:
    parts = [f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, v FROM ({_whole(1024)}) WHERE len(v) = 64)",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (
  SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, best.j AS j, best.d AS d FROM (
    SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'j': j}}) AS best FROM (
      SELECT k.r, k.vec_id, k.v, c.j, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
      FROM kept k CROSS JOIN c{i} c) GROUP BY r))""")
        if i < rounds:
            # floor of s / n for either sign
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY j, i) GROUP BY j) m ON m.j = c.j)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""


def _fits(pattern: str) -> str:
    return f"regexp_matches(a, {_text(url_filter.regex_of(pattern).replace(chr(92) + 'Z', chr(92) + 'z'))})"


def url_filter_sql() -> str:
    """Every rule on every address."""
    named = sorted((r for r in RULES if r.name is not None), key=lambda r: -len(r.name))
    others = sorted((r for r in RULES if r.name is None), key=lambda r: r.pattern)
    first = [" ".join(f"WHEN {_fits(r.pattern)} THEN {_text(getattr(r, of))}" for r in named) for of in ("name", "verdict", "pattern")]
    by_verdict = [f"coalesce({', '.join(f'CASE WHEN {_fits(r.pattern)} THEN {_text(r.pattern)} END' for r in others if r.verdict == v) or 'NULL'}, NULL)"
                  for v in ("allow", "block")]
    return f"""WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS host FROM rest),
addresses AS (SELECT page_id, coalesce(translate(host, '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(substr(rest, length(host) + 1), '^([^?#]*)', 1), '') AS path FROM hosts),
judged AS (SELECT page_id, host, path, host || path AS a, CASE {first[0].replace('(a,', '(host || path,')} END AS rule,
  CASE {first[1].replace('(a,', '(host || path,')} END AS named_verdict, CASE {first[2].replace('(a,', '(host || path,')} END AS named_pattern FROM addresses)
SELECT page_id, host, path, rule, coalesce(named_verdict, CASE WHEN {by_verdict[0]} IS NULL AND {by_verdict[1]} IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(named_pattern, {by_verdict[0]}, {by_verdict[1]}) AS pattern FROM judged"""


# Every pair that shares a shingle, counted in full; then everything that links reach.
JACCARD = f"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS common
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
links AS MATERIALIZED (SELECT u, v FROM pairs WHERE 100 * common >= 75 * (nu + nv - common)),
edges AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, e.v FROM reach r JOIN edges e ON e.u = r.b),
classes AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN classes ON a = doc_id"""

_ESCAPED = r"regexp_replace({x}, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g')"
_ROLE = "replace(replace(" + _ESCAPED.format(x="role") + r", '\', '\b'), chr(10), '\n')"
CHAT = f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, r)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    {len(chat.OPEN) + len(chat.CLOSE) + 2} + length({_ROLE}) + length({_ESCAPED.format(x='body')}) AS chars FROM turns),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(body)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id"""

HOST_RULES = f"""WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts)
  WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
windows AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id),
counts AS (
  SELECT x.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[{host_rules.SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM texts x LEFT JOIN lines l ON l.doc_id = x.doc_id LEFT JOIN covered c ON c.doc_id = x.doc_id),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
ruled AS (SELECT *, base_failed OR 100 * n_symbols > 25 * word_chars AS rule_failed FROM failed),
hosts AS (SELECT source AS host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE rule_failed) AS DOUBLE) AS x FROM ruled WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT CASE WHEN sum(n) > 0 THEN sum(x) / sum(n) ELSE 0 END AS m, var_pop(x / n) AS v, avg(1 / n) AS i FROM hosts),
prior AS (SELECT m, CASE WHEN m <= 0 OR m >= 1 THEN 1.0 WHEN v / (m * (1 - m)) - i <= 0 THEN 1000.0
  ELSE least(1000.0, greatest(1.0, (1 - i) / (v / (m * (1 - m)) - i) - 1)) END AS k FROM moments)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce((x + m * k) / (n + k), 0) <= 0.6 AS kept, source, rule_failed, round((x + m * k) / (n + k), 6) AS host_rate
FROM ruled CROSS JOIN prior LEFT JOIN hosts ON host = source"""


ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter_sql(),
    "op6_jaccard_join": JACCARD,
    "op7_chat_format": CHAT,
    "op10_host_rules": HOST_RULES,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_clusters": clusters(),
}

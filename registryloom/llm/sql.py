"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from registryloom.llm.chat import CLOSE, LEARNED_ROLE, MID, OPEN, ROLE_ESCAPES, TEXT_ESCAPES
from registryloom.llm.quality_rules import DELTA, LEVELS, RISK, RULES
from registryloom.llm.queries import PROBE, URL_RULES
from registryloom.llm.shingle_join import PERCENT, SHINGLE
from registryloom.llm.url_rules import SiteRule

_SITES = [r for r in URL_RULES if isinstance(r, SiteRule)]
_GLOBS = [r for r in URL_RULES if not isinstance(r, SiteRule)]


def _site_row(r: SiteRule) -> str:
    return f"('{r.host}', '{r.path}', '{r.name}', '{r.verdict}')"


def _glob_row(r) -> str:
    like = r.glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return f"('%{like}%', '{r.name}', '{r.verdict}')"


URL_FILTERS = f"""
WITH sites(rule_host, rule_path, rule, says) AS (VALUES {", ".join(map(_site_row, _SITES))}),
globs(pattern_like, pattern, says) AS (VALUES {", ".join(map(_glob_row, _GLOBS))}),
cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, url,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), numbered AS (SELECT row_number() OVER () AS n, * FROM parts
), best AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
  FROM numbered JOIN sites ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n
), fitting AS (
  SELECT n, min(says || ' ' || pattern) AS first_fit
  FROM numbered JOIN globs
    ON translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE pattern_like ESCAPE '\\'
  GROUP BY n
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IS NULL THEN substr(first_fit, instr(first_fit, ' ') + 1) END AS pattern,
  coalesce(best.says, split_part(first_fit, ' ', 1), 'allow') AS verdict
FROM numbered LEFT JOIN best USING (n) LEFT JOIN fitting USING (n)
"""

def _escaped(text: str, escapes) -> str:
    for plain, written in escapes:
        text = f"replace({text}, '{plain}', '{written}')"
    return text


CHAT_FORMATTING = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED_ROLE}'), '') AS learned,
    sum({len(OPEN + MID + CLOSE)} + length({_escaped("role", ROLE_ESCAPES)})
      + length({_escaped("text", TEXT_ESCAPES)}))::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(learned) AS loss_chars,
  sha256(learned) AS loss_sha256, formatted_chars
FROM whole
"""

BLANKS = r"[\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANKS}'), lambda x: x <> '')"


JACCARD_JOIN = f"""
WITH RECURSIVE tokens AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= {SHINGLE} THEN
      list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM tokens
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
meets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

_MEASURED = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "shouts_per_word": "n_shouts / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}


def _rejected_at(rule: str) -> str:
    """Rule, level and cutoff spelled out, so that no formula decides which level is the first."""
    loose, strict = RULES[rule]
    cuts = [loose * (strict / loose) ** (k / (LEVELS - 1)) for k in range(LEVELS - 1)] + [strict]
    cases = " ".join(f"WHEN {_MEASURED[rule]} > {c!r} THEN {k + 1}" for k, c in enumerate(cuts))
    return f"CASE {cases} END"


_COUNT = "len(regexp_extract_all(body, '{}'))"
QUALITY_RULES = f"""
WITH texts AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS body,
    {_words("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT n, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS win
  FROM texts WHERE len(w) > 2
), again AS (
  SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, win) AS often FROM windows) WHERE often > 1
), repeated AS (
  SELECT n, count(DISTINCT i + j) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) steps(j) GROUP BY n
), measured AS (
  SELECT texts.n, doc_id, stratum, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    {_COUNT.format("[#*$%&|<>]")} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    {_COUNT.format("!")} AS n_shouts, {_COUNT.format("[A-Z]")} AS n_upper, {_COUNT.format("[A-Za-z]")} AS n_letters
  FROM texts LEFT JOIN repeated USING (n)
), strict AS (
  SELECT *, least({", ".join(map(_rejected_at, RULES))}) AS at_level FROM measured
), said AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
labelled AS (SELECT stratum, at_level, quality FROM strict JOIN said USING (doc_id)),
grid AS (SELECT stratum, unnest(range(1, {LEVELS + 1})) AS level FROM (SELECT DISTINCT stratum FROM labelled)),
rates AS (
  SELECT g.stratum, g.level, count(*) FILTER (quality = 1) AS good,
    count(*) FILTER (quality = 1 AND at_level <= g.level) AS k, count(*) FILTER (quality <> 1 AND at_level <= g.level) AS bad
  FROM grid g JOIN labelled l ON l.stratum = g.stratum GROUP BY 1, 2
), chances AS (
  SELECT *, CASE WHEN k >= good * {RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(good + 1.0) - lgamma(i + 1.0) - lgamma(good - i + 1.0)
      + i * ln({RISK}) + (good - i) * ln(1 - {RISK})))) END AS chance
  FROM rates
), worst AS (SELECT *, max(chance) OVER (PARTITION BY stratum ORDER BY level) AS worst FROM chances),
chosen AS (
  SELECT stratum, arg_max(level, bad * {LEVELS + 1} - level) AS level FROM worst
  WHERE worst <= {DELTA} / (SELECT count(DISTINCT stratum) FROM rates) GROUP BY stratum
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM strict LEFT JOIN chosen USING (stratum)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(at_level <= level, false) AS kept
FROM judged
"""

HARD_NEGATIVES = """
WITH held AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), points AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
    list_inner_product(a.v, o.v)::BIGINT AS score
  FROM held a JOIN held o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM points WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
  n.other_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN points n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 100 * n.score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""

LLM_ORACLES = {
    "op1_jaccard_join": JACCARD_JOIN,
    "op3_url_filters": URL_FILTERS,
    "op5_quality_rules": QUALITY_RULES,
    "op7_chat_formatting": CHAT_FORMATTING,
    "op12_hard_negatives": HARD_NEGATIVES,
}

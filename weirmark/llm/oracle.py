"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

import re

from weirmark.llm import hard_negatives as hard
from weirmark.llm import mixing
from weirmark.llm import quality_rules as quality
from weirmark.llm import url_rules as urls

SPACE = r"\x20\x09-\x0D"


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)


def op1_quality_rules() -> str:
    bound = quality.ERROR / (len(quality.RULES) * (len(quality.STRATA) + 1))
    tests = _values([(r.name, c) for r in quality.RULES for c in r.cutoffs])
    share = lambda r: r.share.replace(" DIV ", " // ")
    shares = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r.name}' AS rule, {share(r)} AS v FROM base" for r in quality.RULES)
    fails = ", ".join(
        f"CASE WHEN {share(r)} > (SELECT min(cut) FROM safe s WHERE s.stratum = b.stratum AND s.rule = '{r.name}') THEN '{r.name}' END"
        for r in quality.RULES
    )
    return rf"""
WITH src AS (
  SELECT doc_id, CASE WHEN lang IN {quality.STRATA} THEN lang ELSE '{quality.OTHER}' END AS stratum,
    coalesce(text, '') AS text FROM documents
), t AS (
  SELECT *, regexp_extract_all(text, '[^{SPACE}]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l FROM src
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g
  FROM t, unnest(range(1, len(w) - 3)) AS r(i)
), found AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams
), repeats AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM found, range(0, 5) AS s(j) WHERE n >= 2 GROUP BY doc_id
), base AS (
  SELECT doc_id, stratum, len(w) AS n_words, length(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN repeats USING (doc_id)
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
), good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), shares AS ({shares}
), held AS (
  SELECT s.* FROM shares s JOIN judged j USING (doc_id) WHERE NOT j.base_failed AND doc_id IN (SELECT doc_id FROM good)
), tests AS (
  SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER (v > cut) AS k
  FROM held JOIN (VALUES {tests}) AS c(rule, cut) USING (rule) GROUP BY ALL
), safe AS (
  SELECT stratum, rule, cut FROM tests WHERE k <= {quality.RISK} * n AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({quality.RISK}) + (n - j) * ln(1 - {quality.RISK})))
    FROM unnest(range(0, k + 1)) AS r(j)) <= {bound}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  len(list_filter([{fails}], lambda x: x IS NOT NULL)) AS n_rejections,
  NOT base_failed AND len(list_filter([{fails}], lambda x: x IS NOT NULL)) = 0 AS kept
FROM judged b
"""


def _pattern(glob: str) -> str:
    """The same glob as a regular expression."""
    parts = re.findall(r"\*\*|\*|\\.|[^*\\]", glob)
    return "".join({"**": ".*", "*": "[^/?#]*"}.get(p, re.escape(p[-1])) for p in parts)


def op7_url_rules() -> str:
    hosts = _values([(i, r.host, r.path, r.verdict) for i, r in enumerate(urls.HOST_RULES)])
    globs = _values([(i, r.glob, f"(?s){_pattern(r.glob)}", r.verdict) for i, r in enumerate(urls.GLOB_RULES)])
    return rf"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u,
    translate(regexp_extract(u, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '://([^/?#]*)([^?#]*)', 2) AS path,
    regexp_extract(u, '://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS query
  FROM pages
), h(i, rhost, rpath, verdict) AS (VALUES {hosts}
), g(i, shape, pattern, verdict) AS (VALUES {globs}
), best AS (
  SELECT *, (SELECT struct_pack(rule := rhost || rpath, verdict := verdict) FROM h
      WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
      ORDER BY length(rhost || rpath) DESC, i LIMIT 1) AS r,
    (SELECT struct_pack(shape := shape, verdict := verdict) FROM g
      WHERE regexp_full_match(host || path || query, pattern) ORDER BY length(shape) DESC, i LIMIT 1) AS b
  FROM p
)
SELECT page_id, host, path, r.rule AS rule, CASE WHEN r IS NULL THEN b.shape END AS "glob",
  coalesce(r.verdict, b.verdict, 'allow') AS verdict
FROM best
"""


def op8_mixing() -> str:
    topic = re.sub(r"text RLIKE ('[^']*')", r"regexp_matches(text, \1)", mixing.TOPIC)
    steps, last = [], "start"
    for target in mixing.TARGETS:
        wish = " ".join(f"WHEN '{v}' THEN {float(times)!r}" for v, times in target.preference)
        wish = f"CASE {target.column} {wish} ELSE 1.0 END" if wish else "1.0"
        steps.append(
            f"t_{target.column} AS (SELECT {target.column}, p / sum(p) OVER () AS t FROM (SELECT {target.column},"
            f" pow(CAST(sum(tokens) AS DOUBLE), {target.temper!r}) * {wish} AS p FROM cells GROUP BY {target.column}))"
        )
    for turn in range(mixing.ROUNDS):
        for c in (target.column for target in mixing.TARGETS):
            now = f"w_{turn}_{c}"
            steps.append(
                f"{now} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * (t / sum(w) OVER (PARTITION BY {c})) AS w"
                f" FROM {last} JOIN t_{c} USING ({c}))"
            )
            last = now
    return rf"""
WITH src AS (
  SELECT doc_id, coalesce(source, '{mixing.NONE}') AS source, coalesce(lang, '{mixing.NONE}') AS lang,
    coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS n_tokens
  FROM documents
), marked AS (SELECT doc_id, source, lang, n_tokens, {topic} AS topic FROM src
), cells AS (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM marked WHERE n_tokens > 0 GROUP BY ALL
), start AS (SELECT *, tokens AS w FROM cells
), {", ".join(steps)}, rates AS (
  SELECT source, lang, topic, w * (SELECT sum(tokens) FROM cells) / tokens AS rate FROM {last}
), found AS (
  SELECT m.*, rate, CASE WHEN n_tokens > 0 THEN rate / (SELECT max(rate) FROM rates) ELSE 0 END AS p
  FROM marked m LEFT JOIN rates USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate, round(p, 6) AS probability,
  CAST('0x' || substr(md5('{mixing.SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept
FROM found
"""


def op12_hard_negatives() -> str:
    return f"""
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % {hard.TURNED} = 0 THEN (label + 1) % {hard.CLASSES} ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({hard.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM base a JOIN base b ON a.vec_id % {hard.ANCHORS} = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {hard.POSITIVES}
), found AS (
  SELECT p.*, other_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives p JOIN scored USING (anchor_id)
  WHERE NOT same AND {hard.LEAST} * positive_score <= 100 * score AND 100 * score <= {hard.MOST} * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= {hard.NEGATIVES}
"""


ORACLE: dict[str, str] = {
    "op1_quality_rules": op1_quality_rules(),
    "op8_mixing": op8_mixing(),
    "op7_url_rules": op7_url_rules(),
    "op12_hard_negatives": op12_hard_negatives(),
}

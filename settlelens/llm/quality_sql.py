"""The SQL that the quality query must agree with."""

from settlelens.llm.quality import ERROR, MAX_REPEAT_PERCENT, MIN_WORDS, RISK, path


def statistics_ctes() -> str:
    """CTEs up to ``stats``: the statistics of each document, with a row number, its language and its source."""
    return """
WITH body AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM body
), win AS (
  SELECT rid, i, array_to_string(w[i:i+4], ' ') AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM cut)
), twice AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, t) > 1
), repeats AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid
), stats AS (
  SELECT c.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_upper,
    CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_exclaims,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM cut c LEFT JOIN repeats r ON r.rid = c.rid
)"""


def quality_sql() -> str:
    steps = " ".join(f"WHEN {r.condition(c)} THEN {t}" for t, (r, c) in enumerate(path()))
    names = " ".join(f"WHEN {t} THEN '{r.name}'" for t, (r, _) in enumerate(path()))
    share = f"CAST({RISK} AS DOUBLE)"
    return statistics_ctes() + f""", based AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
    CASE {steps} END AS step FROM stats
), marks AS (
  SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), held AS (
  SELECT b.lang, b.step, m.good FROM based b JOIN marks m ON m.doc_id = b.doc_id WHERE NOT base_failed
), sizes AS (
  SELECT lang, count(*) AS n FROM held WHERE good = 1 GROUP BY lang
), sums AS (
  SELECT lang, step, sum(g) OVER upto AS good_hits, sum(b) OVER upto AS bad_hits
  FROM (SELECT lang, step, count(*) FILTER (WHERE good = 1) AS g, count(*) FILTER (WHERE good = 0) AS b FROM held WHERE step IS NOT NULL GROUP BY ALL)
  WINDOW upto AS (PARTITION BY lang ORDER BY step)
), terms AS (
  SELECT lang, n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({share}) + (n - k) * ln(1 - {share})))
    OVER (PARTITION BY lang ORDER BY k) AS total
  FROM (SELECT lang, n, unnest(range(0, CAST(floor(n * {share}) AS BIGINT) + 1)) AS k FROM sizes)
), allowed AS (
  SELECT lang, max(k) AS allowed FROM terms WHERE total <= CAST({ERROR} AS DOUBLE) / (SELECT count(*) FROM sizes) GROUP BY lang
), chosen AS (
  SELECT s.lang, arg_max(step, (bad_hits - good_hits) * 1000 - step) AS last_step
  FROM sums s JOIN allowed a ON a.lang = s.lang WHERE good_hits <= allowed AND bad_hits > good_hits GROUP BY s.lang
), judged AS (
  SELECT b.*, CASE WHEN step <= last_step THEN CASE step {names} END END AS rejected_by
  FROM based b LEFT JOIN chosen c ON c.lang = b.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by,
  (NOT base_failed AND rejected_by IS NULL) AS kept FROM judged"""

"""Removal of boilerplate lines that occur on many sites.

A line counts as trimmed text; its key is a 128-bit digest. Lines seen in at least ``min_sites`` rows get
a HyperLogLog sketch of the sites they occur on; partial sketches merge in the aggregation. A line whose
estimate is clearly over or under the threshold is decided by it; lines near the threshold get an exact
count of distinct sites. A boilerplate line is removed everywhere but in its first place (the smallest
document id, then the first line), so copies of a whole document on many sites leave one of them whole.

Edge cases. A null text counts as empty. Lines without a word are never removed. A row without a site
adds no site to its lines, but loses boilerplate like any other. Rows without an id come after all others
when the first place is chosen. Repeated rows are one document and share their lines' fate. An empty table
gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlelens.llm.common import WORD, materialize, null_safe_text

MIN_SITES = 6
LOG_REGISTERS = 12  # 4,096 registers: a standard error of 1.6 percent
BAND = 0.06  # over three standard errors to each side of the threshold are counted exactly
BLANKS = " \t\x0b\f\r"


def _keyed(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    text = null_safe_text(text_col)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("text_code"),  # tells rows of one id apart
        F.col(site_col).cast("string").alias("site"),
        text.alias("text"),
    )


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_code, site, pos, key) of every line that has a word."""
    lines = docs.select("doc_id", "text_code", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = F.unhex(F.md5(F.btrim("line", F.lit(BLANKS)).cast("binary")))
    return lines.where(F.col("line").rlike(WORD)).select("doc_id", "text_code", "site", "pos", key.alias("key"))


def wide_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(key) of the lines that occur on at least ``min_sites`` sites."""
    often = lines.groupBy("key").count().where(F.col("count") >= min_sites).select("key")
    sites = lines.join(often, "key", "left_semi").select("key", "site")
    spread = sites.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("about"))
    spread = materialize(spread, "line-spread")
    margin = max(1.0, BAND * min_sites)
    near = spread.where(F.abs(F.col("about") - min_sites) <= margin).select("key")
    exact = sites.join(near, "key", "left_semi").distinct().groupBy("key").agg(F.count("site").alias("sites"))
    clear = spread.where(F.col("about") - min_sites > margin).select("key")
    return clear.union(exact.where(F.col("sites") >= min_sites).select("key"))


def without_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """One row per row: doc_id, n_lines (with a word), n_removed and the remaining ``text``."""
    keyed = _keyed(docs, id_col, text_col, site_col)
    lines = materialize(line_table(keyed), "lines")
    wide = materialize(wide_lines(lines, min_sites), "wide-lines")
    hits = lines.join(wide, "key", "left_semi")
    # Nulls last: a line stays in a document that can be named if there is one.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_code", "pos")
    first = hits.groupBy("key").agg(F.min(place).alias("stays"))
    gone = hits.join(first, "key").where(~place.eqNullSafe(F.col("stays")))
    holes = gone.groupBy("doc_id", "text_code").agg(F.collect_set("pos").alias("holes"))
    holes = materialize(holes.withColumnsRenamed({"doc_id": "hole_id", "text_code": "hole_code"}), "line-holes")
    same = F.col("doc_id").eqNullSafe(F.col("hole_id")) & (F.col("text_code") == F.col("hole_code"))
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda _, i: ~F.array_contains("holes", i))
    n_lines = F.size(F.filter(parts, lambda line: line.rlike(WORD)))
    return keyed.join(holes, same, "left").select(
        "doc_id",
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("holes"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("holes").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
    )


LINES_SQL = f"""
WITH body AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT rid, doc_id, source, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT rid, doc_id, source, string_split(text, chr(10)) AS l FROM body)
), keyed AS (
  SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS word, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM parts
), wide AS (
  SELECT k, count(DISTINCT source) AS sites FROM keyed WHERE word GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT p.*, (w.k IS NOT NULL AND row_number() OVER (PARTITION BY p.word, p.k ORDER BY p.doc_id NULLS LAST, p.pos) > 1) AS gone
  FROM keyed p LEFT JOIN wide w ON w.k = p.k AND p.word
), left_over AS (
  SELECT rid, any_value(doc_id) AS doc_id, count(*) FILTER (WHERE word) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY rid
)
SELECT doc_id, n_lines, n_removed, sha256(text) AS kept_sha256 FROM left_over"""

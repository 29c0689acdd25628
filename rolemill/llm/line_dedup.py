"""Lines that many sites share, removed but for their first occurrence.

A line is compared without white space around it. Its spread is the number of
distinct sites (``source``) it occurs on. Lines of one site are set aside first; the
others get a HyperLogLog sketch each, which Spark merges by aggregation. Estimates
near the threshold are replaced by exact distinct counts, so the verdict is that of
an exact count. Of a spread line the occurrence with the smallest key and position
stays; all others go.

Lines under ``min_words`` words and blank lines stay. Null sites are no site; a null
text stays null and has no lines; rows equal in key and text are treated alike. Keys
may be null (they come last) or repeated.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm.tables import keep

SITES = 3
MIN_WORDS = 3
LG_K = 12
# An estimate within this share of the threshold, or 1, is checked exactly.
NEAR = 0.15
SPACES = " \t\x0b\x0c\r"
_WORD, _GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def _lines(docs: DataFrame, key: str, text: str, site: str, min_words: int) -> DataFrame:
    """Countable lines with two hashes, the row they are in and their position."""
    enough = _GAP.join([_WORD] * min_words)
    line = F.trim(F.col("_line"), F.lit(SPACES))
    return (docs.select(*_row_key(key, text), F.col(key).alias("_id"),
                        F.col(site).alias("_site"),
                        F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
            .where(F.col("_line").rlike(enough))
            .select("_r1", "_r2", "_id", "_site", "_pos",
                    F.xxhash64(line).alias("_h1"),
                    F.xxhash64(F.lit(1), line).alias("_h2")))


def _row_key(key: str, text: str):
    return (F.xxhash64(key, text).alias("_r1"),
            F.xxhash64(F.lit(1), text, key).alias("_r2"))


def spread_lines(occurrences: DataFrame, sites: int, lg_k: int = LG_K) -> DataFrame:
    """(_h1, _h2) of the lines on ``sites`` or more distinct sites."""
    line = ["_h1", "_h2"]
    estimates = keep(occurrences.groupBy(*line).agg(F.hll_sketch_estimate(
        F.hll_sketch_agg("_site", lg_k)).alias("_sites")))
    margin = max(1.0, NEAR * sites)
    near = (F.col("_sites") > sites - margin - 0.5) & (F.col("_sites") < sites + margin + 0.5)
    exact = (occurrences.join(estimates.where(near).select(*line), line, "left_semi")
             .groupBy(*line).agg(F.countDistinct("_site").alias("_sites"))
             .where(F.col("_sites") >= sites))
    sure = estimates.where(~near & (F.col("_sites") >= sites))
    return sure.select(*line).unionByName(exact.select(*line))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                site: str = "source", sites: int = SITES,
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the cleaned ``text`` and, new, ``n_lines`` and ``n_removed``."""
    line, row = ["_h1", "_h2"], ["_r1", "_r2"]
    lines = _lines(docs, key, text, site, min_words)
    shared = (lines.groupBy(*line).agg(F.min("_site").alias("_a"), F.max("_site").alias("_b"))
              .where("_a < _b").select(*line))
    occurrences = keep(lines.join(shared, line, "left_semi"))
    spread = keep(spread_lines(occurrences, sites))
    place = F.struct(F.col("_id").isNull().alias("n"), "_id", *row, "_pos")
    found = occurrences.join(spread, line, "left_semi")
    first = found.groupBy(*line).agg(F.min(place).alias("_first"))
    removed = (found.join(first, line).where(place > F.col("_first"))
               .groupBy(*row).agg(F.collect_set("_pos").alias("_gone")))
    parts = F.split(text, "\n")
    n = F.size(parts)
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_parts"), i)), "\n")
    out = (docs.select("*", *_row_key(key, text)).join(removed, row, "left")
           .withColumn("_parts", parts))
    return out.select(
        *[F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept).alias(text)
          if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_parts")).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
        .alias("n_removed"))


SQL = r"""
WITH cut AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, source, text, unnest(parts) AS raw,
         unnest(range(len(parts))) AS pos FROM cut),
named AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
         regexp_matches(raw, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+') AS counted
  FROM lines),
spread AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS f FROM named
  WHERE counted GROUP BY line HAVING count(DISTINCT source) >= 3),
marked AS (
  SELECT n.doc_id, n.raw, n.pos,
         s.line IS NOT NULL AND struct_pack(d := n.doc_id, p := n.pos) > s.f AS gone
  FROM named n LEFT JOIN spread s ON n.counted AND n.line = s.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""

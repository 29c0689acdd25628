"""Five stages from raw documents to packed training sequences.

Toxic documents go; lines that many sites share go but for their first occurrence;
one document of each group of near copies stays; personal values get pseudonyms; what
is left is packed into sequences. Each stage works on all rows its predecessor kept.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.llm import line_dedup, ngram_join, packing, pii, toxicity
from rolemill.llm.tables import keep, read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, name="_score")
    return scored.where("_score < 0.5").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, without the lines that other sites have had before. A document
    that this leaves without words goes: all it said stands in the first occurrences."""
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = line_dedup.dedup_lines(docs).where(~F.coalesce(emptied, F.lit(False)))
    return out.select(*[_n_chars() if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, null ids last.
    Documents without words are no copies of each other and stay; of rows equal in id
    and text one stays."""
    rows = keep(docs.withColumn("_row", F.monotonically_increasing_id()))
    linked = ngram_join.link(rows, key="_row").select(
        F.col("doc_id").alias("_row"), "k", "n_shingles", "component_id")
    alone = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = [alone.alias("_alone"), F.when(alone, F.col("k")).otherwise(
        F.col("component_id")).alias("_group"), F.when(alone, F.col("doc_id")).alias("_id")]
    first = (rows.select("_row", "doc_id").join(linked, "_row").groupBy(*group)
             .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k", "_row")).alias("_first"))
             .select("_first._row"))
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal values."""
    out = pii.pseudonymise(docs, found="_found")
    return out.select(*[_n_chars() if c == "n_chars" else F.col(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence."""
    return packing.pack(docs)


def _n_chars():
    return F.length("text").cast("long").alias("n_chars")


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage),
          ("ngram_join", near_duplicate_stage), ("pii", pii_stage),
          ("packing", packing_stage)]
# The classifier, linking and packing are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

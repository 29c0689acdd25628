"""Employer table: resolve, board discovery, metrics, refresh order."""

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolemill.functions.binding import let

_FILLED = ["domain", "website", "ats_platform", "ats_board_token"]


def seen_companies(jobs: DataFrame) -> DataFrame:
    """One row per normalised employer name found in a batch.

    The first posting in arrival order names the employer; each attribute comes
    from the first posting that has it. ``min_by`` and ``min`` combine map-side,
    so an employer with most of the postings costs one record per task.
    """
    c = F.col

    def first(value):
        return F.min_by(value, F.when(value.isNotNull(), c("seq")))

    board = F.when(c("board").isNotNull(), c("board"))
    return (jobs.where(F.coalesce("company_key", F.lit("")) != "")
            .groupBy("company_key").agg(
                F.min_by(F.trim("company_name_raw"), "seq").alias("name"),
                first(c("company_domain")).alias("domain"),
                first(c("company_website")).alias("website"),
                first(board).alias("_board"),
                F.min("date_collected").alias("first_seen_at"),
                F.max("date_collected").alias("last_seen_at"))
            .withColumn("ats_platform", c("_board.platform"))
            .withColumn("ats_board_token", c("_board.token")).drop("_board"))


def resolve_companies(stored: DataFrame, batch_jobs: DataFrame) -> DataFrame:
    """Stored employers with the batch folded in.

    New names are inserted; known ones keep every value they have, get the
    missing ones filled and their last sighting moved.
    """
    seen = seen_companies(batch_jobs)
    new = seen.select("company_key", *[F.col(x).alias(f"_{x}")
                                       for x in seen.columns if x != "company_key"])
    joined = stored.join(new, "company_key", "full_outer")
    # The board is one unit: platform and token come from the same side.
    own_board = F.col("ats_board_token").isNotNull()
    out = {
        "name": F.coalesce("name", "_name"),
        "domain": F.coalesce("domain", "_domain"),
        "website": F.coalesce("website", "_website"),
        "ats_platform": F.when(own_board, F.col("ats_platform")).otherwise(
            F.coalesce("_ats_platform", "ats_platform")),
        "ats_board_token": F.coalesce("ats_board_token", "_ats_board_token"),
        "first_seen_at": F.coalesce("first_seen_at", "_first_seen_at"),
        "last_seen_at": F.coalesce(F.greatest("last_seen_at", "_last_seen_at"),
                                   "last_seen_at", "_last_seen_at"),
    }
    return joined.select("company_key", *[
        out.get(x, F.col(x)).alias(x) for x in stored.columns if x != "company_key"])


def discover_boards(jobs: DataFrame) -> DataFrame:
    """First detected board per employer name, in arrival order."""
    # A condition on the board, or a second mention, would repeat its reading.
    first = F.min(let(F.col("board"), lambda b: F.when(
        b.isNotNull(), F.struct("seq", b.alias("board"))))).alias("first")
    named = jobs.where("company_name_raw is not null")
    return (named.groupBy("company_name_raw")
            .agg(first).where("first is not null")
            .select("company_name_raw", "first.board.platform", "first.board.token"))


def boards_to_refresh(companies: DataFrame, name: str | None = None,
                      limit: int = 25) -> DataFrame:
    """Boards due per platform, longest unseen first."""
    due = companies.where("ats_platform is not null and ats_board_token is not null")
    if name:
        due = due.where(F.contains(F.lower("name"), F.lower(F.lit(name))))
    order = Window.partitionBy("ats_platform").orderBy(
        F.asc_nulls_first("last_seen_at"), "company_key")
    return (due.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= limit)
            .select("ats_platform", "rank", "ats_board_token", "name"))


def boards_known(companies: DataFrame) -> DataFrame:
    return (companies.where("ats_board_token is not null and ats_platform is not null")
            .groupBy("ats_platform").agg(F.count(F.lit(1)).alias("boards")))


def refresh_metrics(companies: DataFrame, jobs: DataFrame,
                    as_of: dt.datetime) -> DataFrame:
    """Employers with ``jobs_discovered`` and ``hiring_frequency_30d`` recounted."""
    since = F.lit(as_of - dt.timedelta(days=30))
    counts = jobs.where("is_primary").groupBy("company_key").agg(
        F.count(F.lit(1)).alias("_jobs"),
        F.count_if(F.col("date_posted") >= since).alias("_recent"))
    return (companies.drop("jobs_discovered", "hiring_frequency_30d")
            .join(counts, "company_key", "left")
            .withColumn("jobs_discovered", F.coalesce("_jobs", F.lit(0)))
            .withColumn("hiring_frequency_30d",
                        F.round(F.coalesce("_recent", F.lit(0)) / 4.3, 2))
            .drop("_jobs", "_recent"))

"""Research notes and tags."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill import vocab

_FIELDS = ["status", "priority", "lead_quality", "notes", "follow_up_at"]


def apply_updates(research: DataFrame, updates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Research with a table of partial updates folded in.

    A NULL in ``updates`` leaves the stored value; unknown jobs are skipped; a
    job without a row gets one with status "new".
    """
    known = updates.join(jobs.select("job_id"), "job_id", "left_semi")
    given = [f for f in _FIELDS if f in updates.columns and f in research.columns]
    new = known.select("job_id", F.lit(True).alias("_touched"),
                       *[F.col(f).alias(f"_{f}") for f in given])
    joined = research.withColumn("_stored", F.lit(True)).join(new, "job_id", "full_outer")
    out = []
    for f in research.columns:
        value = F.coalesce(f"_{f}", f) if f in given else F.col(f)
        if f == "status":
            fresh = F.col("_stored").isNull()
            value = F.when(fresh, F.coalesce(value, F.lit("new"))).otherwise(value)
        out.append(value.alias(f))
    return joined.select(*out)


def change_tags(job_tags: DataFrame, add: DataFrame | None = None,
                remove: DataFrame | None = None) -> DataFrame:
    """Tag set per job after adding and removing (job_id, tag) pairs."""
    result = job_tags
    if add is not None:
        result = result.unionByName(add)
    result = result.select("job_id", F.trim("tag").alias("tag")).where("tag != ''")
    if remove is not None:
        result = result.join(remove, ["job_id", "tag"], "left_anti")
    return result.distinct()


def replace_tags(job_tags: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs named in ``new`` get exactly these tags, the others keep theirs.

    A NULL tag in ``new`` clears the job's set.
    """
    kept = job_tags.join(new.select("job_id"), "job_id", "left_anti")
    return change_tags(kept, add=new.where("tag is not null"))


def status_summary(research: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows per status, every status present; primary jobs nobody has looked at
    count as new."""
    spark = research.sparkSession
    counted = (research.groupBy(F.coalesce("status", F.lit("new")).alias("status"))
               .agg(F.count(F.lit(1)).alias("n")))
    unseen = (jobs.where("is_primary").select("job_id")
              .join(research.select("job_id"), "job_id", "left_anti")
              .agg(F.lit("new").alias("status"), F.count(F.lit(1)).alias("n")))
    names = spark.createDataFrame([(s, 0) for s in vocab.RESEARCH_STATUSES],
                                  "status string, n long")
    return (names.union(counted).union(unseen.select("status", "n"))
            .groupBy("status").agg(F.sum("n").alias("n")))


def tag_counts(tags: DataFrame, job_tags: DataFrame) -> DataFrame:
    """Jobs per tag, unused tags included, most used first."""
    counts = job_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return (tags.join(counts, "tag", "left")
            .withColumn("n", F.coalesce("n", F.lit(0)))
            .orderBy(F.desc("n"), "tag"))

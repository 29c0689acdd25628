"""Facets, breakdowns and trends over a filtered scope."""

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolemill.functions import pay

# --- fixed values: list lengths per dimension ---
FACETS = {"company_name_raw": 12, "state": 12, "city": 12, "work_arrangement": 5,
          "employment_type": 6, "experience_level": 6}
FACET_SKILLS = 12
BREAKDOWNS = {"company_name_raw": 15, "state": 15, "city": 15,
              "title_normalized": 15, "employment_type": 8, "experience_level": 8,
              "education_level": 8}
TIMELINE_DAYS = 60
OVERVIEW_SKILLS = 30


def _one():
    return F.lit(1)


def count_values(scope: DataFrame, dims: dict, by: tuple = ()) -> DataFrame:
    """(by…, dim, value, n) for several columns in one pass over the scope.

    Each row is expanded to one record per dimension and counted map-side
    before the shuffle, so a hot value costs one record per task.
    """
    cells = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"))
             for d in dims]
    return (scope.select(*by, F.explode(F.array(*cells)).alias("cell"))
            .select(*by, "cell.dim", "cell.value").where("value is not null")
            .groupBy(*by, "dim", "value").agg(F.count(_one()).alias("n")))


def top_per(counts: DataFrame, keys: list, limits: dict | int) -> DataFrame:
    """Highest counts per key, ties by value; a limit of None keeps all of a dimension.

    The rank filter is applied before the shuffle as well as after it, so a
    dimension with many values never meets in one task unreduced.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order))
    if isinstance(limits, int):
        return ranked.where(F.col("rank") <= limits)
    whole = [dim for dim, n in limits.items() if n is None]
    if whole:
        rest = {dim: n for dim, n in limits.items() if n is not None}
        named = F.col("dim").isin(whole)
        return top_per(counts.where(~named), keys, rest).unionByName(ranked.where(named))
    ranked = ranked.where(F.col("rank") <= max(limits.values()))
    allowed = F.when(F.lit(False), 0)
    for dim, n in limits.items():
        allowed = allowed.when(F.col("dim") == dim, n)
    return ranked.where(F.col("rank") <= allowed)


def explode_skills(scope: DataFrame, *keys: str) -> DataFrame:
    return scope.select(*keys, F.explode("skills").alias("s")).select(
        *keys, F.col("s.name").alias("skill"), F.col("s.requirement").alias("requirement"))


def facets(scope: DataFrame) -> DataFrame:
    """(dim, value, n, rank): six column facets and the skills facet."""
    cells = [F.array(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")))
             for d in FACETS]
    cells.append(F.transform("skills", lambda s: F.struct(
        F.lit("skills").alias("dim"), s["name"].alias("value"))))
    counts = (scope.select(F.explode(F.concat(*cells)).alias("cell"))
              .select("cell.*").where("value is not null")
              .groupBy("dim", "value").agg(F.count(_one()).alias("n")))
    return top_per(counts, ["dim"], {**FACETS, "skills": FACET_SKILLS})


def breakdowns(scope: DataFrame) -> DataFrame:
    """Overview dimensions; the arrangement keeps all values and its unknowns."""
    folded = scope.withColumn("work_arrangement",
                              F.coalesce("work_arrangement", F.lit("unknown")))
    counts = count_values(folded, {**BREAKDOWNS, "work_arrangement": 0})
    return top_per(counts, ["dim"], {**BREAKDOWNS, "work_arrangement": None})


def salary_bands(scope: DataFrame) -> DataFrame:
    pay_col = F.col("salary_annualized_min")
    return (scope.where(pay_col.isNotNull())
            .groupBy(pay.salary_band_order(pay_col).alias("band_order"),
                     pay.salary_band(pay_col).alias("band"))
            .agg(F.count(_one()).alias("n")).orderBy("band_order"))


def timeline(scope: DataFrame, days: int = TIMELINE_DAYS) -> DataFrame:
    """Postings per day for the latest days that have any, oldest first."""
    per_day = (scope.where("date_posted is not null")
               .groupBy(F.to_date("date_posted").alias("day"))
               .agg(F.count(_one()).alias("n")))
    return per_day.orderBy(F.desc("day")).limit(days).orderBy("day")


def salary_summary(scope: DataFrame) -> DataFrame:
    paid = scope.where("salary_annualized_min is not null")
    return paid.agg(F.round(F.avg("salary_annualized_min")).alias("avg_annualized"),
                    F.min("salary_annualized_min").alias("min_annualized"),
                    F.max("salary_annualized_max").alias("max_annualized"))


def skills_ranking(scope: DataFrame, matcher, category: str | None = None,
                   limit: int = 100) -> DataFrame:
    """Skills of the scope with requirement counts and share in percent.

    The scope total rides along as one more counted key instead of a second
    scan joined back.
    """
    total_key = F.array(F.struct(F.lit(None).cast("string").alias("name"),
                                 F.lit(None).cast("string").alias("requirement")))
    rows = scope.select(F.explode(F.concat(
        total_key, F.transform("skills", lambda s: F.struct(
            s["name"].alias("name"), s["requirement"].alias("requirement"))))).alias("s"))
    counts = rows.groupBy(F.col("s.name").alias("skill")).agg(
        F.count(_one()).alias("jobs"),
        F.count_if(F.col("s.requirement") == "required").alias("required_in"),
        F.count_if(F.col("s.requirement") == "preferred").alias("preferred_in"))
    total = F.max(F.when(F.col("skill").isNull(), F.col("jobs"))).over(
        Window.partitionBy())
    ranked = (counts.withColumn("total", total).where("skill is not null")
              .withColumn("category", matcher.category_of(F.col("skill")))
              .withColumn("share", F.round(100.0 * F.col("jobs") / F.col("total"), 1)))
    if category:
        ranked = ranked.where(F.col("category") == category)
    return (ranked.orderBy(F.desc("jobs"), "skill").limit(limit)
            .select("skill", "category", "jobs", "required_in", "preferred_in", "share"))


def top_skills(scope: DataFrame, matcher, limit: int = OVERVIEW_SKILLS) -> DataFrame:
    return (explode_skills(scope).groupBy("skill").agg(F.count(_one()).alias("jobs"))
            .withColumn("category", matcher.category_of(F.col("skill")))
            .orderBy(F.desc("jobs"), "skill").limit(limit))


def top_hiring(jobs: DataFrame, companies: DataFrame, as_of: dt.datetime,
               days: int = 30, limit: int = 25) -> DataFrame:
    """Employers with the most primary postings in the window."""
    since = F.lit(as_of - dt.timedelta(days=days))
    counts = (jobs.where(F.col("is_primary") & (F.col("date_posted") >= since))
              .groupBy("company_key").agg(F.count(_one()).alias("jobs_posted")))
    named = counts.join(companies.select("company_key", "name", "industry",
                                         "ats_platform"), "company_key")
    return (named.orderBy(F.desc("jobs_posted"), "company_key").limit(limit)
            .withColumn("window_days", F.lit(days)))


def company_profile(jobs: DataFrame) -> DataFrame:
    """Counts and pay per employer, for all employers at once."""
    active = F.col("is_active")
    paid = F.when(active & (F.coalesce("salary_annualized_min", F.lit(0.0)) != 0),
                  F.col("salary_annualized_min"))
    return jobs.where("is_primary").groupBy("company_key").agg(
        F.count(_one()).alias("jobs_total"),
        F.count_if(active).alias("jobs_active"),
        F.count_if(active & (F.col("work_arrangement") == "remote")).alias("jobs_remote"),
        F.count(paid).alias("salary_count"), F.min(paid).alias("salary_min"),
        F.max(paid).alias("salary_max"), F.round(F.avg(paid)).alias("salary_avg"))


def company_tallies(jobs: DataFrame) -> DataFrame:
    """(company, dim, value, n) over active primaries; missing means unknown."""
    dims = ["city", "employment_type", "experience_level", "work_arrangement"]
    active = jobs.where(F.col("is_primary") & F.col("is_active"))
    filled = active.select("company_key", *[
        F.coalesce(F.nullif(d, F.lit("")), F.lit("unknown")).alias(d) for d in dims])
    return count_values(filled, dict.fromkeys(dims, 0), by=("company_key",))


def company_skills(jobs: DataFrame, limit: int = 20) -> DataFrame:
    counts = (explode_skills(jobs.where("is_primary"), "company_key")
              .groupBy("company_key", F.col("skill").alias("value"))
              .agg(F.count(_one()).alias("n")))
    return top_per(counts, ["company_key"], limit)


def company_newest(jobs: DataFrame, limit: int = 100) -> DataFrame:
    """Newest active primary postings per employer."""
    order = Window.partitionBy("company_key").orderBy(
        F.desc_nulls_last("date_posted"), "job_id")
    return (jobs.where(F.col("is_primary") & F.col("is_active"))
            .select("company_key", "job_id", "date_posted")
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= limit))


def cadence(jobs: DataFrame, months: int = 6) -> DataFrame:
    """Primary postings per employer and month, latest months with data."""
    per_month = (jobs.where("is_primary and date_posted is not null")
                 .groupBy("company_key",
                          F.date_format("date_posted", "yyyy-MM").alias("month"))
                 .agg(F.count(_one()).alias("n")))
    order = Window.partitionBy("company_key").orderBy(F.desc("month"))
    return (per_month.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= months).drop("rank"))


def overview(jobs: DataFrame) -> DataFrame:
    """Headline numbers of the whole corpus in one aggregate."""
    primary, paid = F.col("is_primary"), F.col("salary_annualized_min").isNotNull()
    return jobs.agg(
        F.count_if(primary & F.col("is_active")).alias("jobs_active"),
        F.count_if(~primary).alias("duplicates_linked"),
        F.count_distinct("company_key").alias("companies"),
        F.count_if(primary & paid).alias("jobs_with_salary"))


def last_run(runs: DataFrame, run_type: str = "collection") -> DataFrame:
    """Newest run of a kind as one row, without sorting the log."""
    newest = F.max_by(F.struct("run_id", "started_at", "results_new", "status"),
                      F.struct("started_at", "run_id"))
    return (runs.where(F.col("run_type") == run_type).agg(newest.alias("r"))
            .where("r is not null").select("r.*"))


def remote_share(scope: DataFrame) -> DataFrame:
    return scope.agg(
        F.count(_one()).alias("jobs"),
        F.count_if(F.col("work_arrangement") == "remote").alias("remote_jobs"),
        F.round(F.count_if(F.col("work_arrangement") == "remote") / F.count(_one()), 4)
        .alias("remote_share"),
        F.count_distinct("company_key").alias("employers"))


def joined_names(bridge: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """Sorted names of a bridge table as one '; '-joined string per key."""
    return bridge.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(value)), "; ").alias(into))

"""Sort orders, pages and run-log tails."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: sortable fields ---
SORT_FIELDS = {
    "date_posted": "date_posted", "date_collected": "date_collected",
    "salary": "salary_annualized_min", "company": "company_name_raw",
    "location": "city", "title": "title", "remote": "work_arrangement",
    "experience": "years_experience_min", "score": "opportunity_score",
}
COMPANY_SORTS = {
    "jobs": F.desc_nulls_last, "frequency": F.desc_nulls_last,
    "score": F.desc_nulls_last, "recent": F.desc_nulls_last,
    "name": F.asc_nulls_first,
}
_COMPANY_COLUMNS = {"jobs": "jobs_discovered", "name": "name",
                    "frequency": "hiring_frequency_30d",
                    "score": "opportunity_score", "recent": "last_seen_at"}


def order_jobs(jobs: DataFrame, sort: str = "relevance",
               direction: str = "desc") -> DataFrame:
    """Total order: the asked-for column, then ``job_id``.

    Relevance means text rank then newest when the search had text, else score
    then newest; it ignores the direction.
    """
    if sort == "relevance":
        if "rank" in jobs.columns:
            keys = [F.asc("rank"), F.desc_nulls_last("date_posted")]
        else:
            keys = [F.desc_nulls_last("opportunity_score"),
                    F.desc_nulls_last("date_posted")]
    elif sort in SORT_FIELDS:
        column = SORT_FIELDS[sort]
        keys = [F.desc_nulls_last(column) if direction == "desc"
                else F.asc_nulls_first(column)]
    else:
        raise ValueError(f"cannot sort by {sort!r}; use one of "
                         + ", ".join(["relevance", *SORT_FIELDS]))
    return jobs.orderBy(*keys, F.asc("job_id"))


def page(ordered: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """One page of an ordered result (offset and limit are the feature here)."""
    return ordered.offset((number - 1) * size).limit(size)


def page_count(scope: DataFrame, size: int = 50) -> DataFrame:
    """Total rows and number of pages, at least one."""
    total = scope.agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("pages", F.greatest(
        F.lit(1), F.ceil(F.col("total") / size)).cast("bigint"))


def order_companies(companies: DataFrame, sort: str = "jobs") -> DataFrame:
    sort = sort if sort in COMPANY_SORTS else "jobs"
    return companies.orderBy(COMPANY_SORTS[sort](_COMPANY_COLUMNS[sort]),
                             F.asc("company_key"))


def log_tail(log: DataFrame, time: str, key: str, limit: int, **equal) -> DataFrame:
    """Newest log rows, optionally for given column values."""
    for column, value in equal.items():
        if value is not None:
            log = log.where(F.col(column) == value)
    return log.orderBy(F.desc(time), F.desc(key)).limit(limit)

"""Flat export records and their sinks."""

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rolemill.operators.aggregates import joined_names
from rolemill.operators.customfields import read_values

# --- fixed values: export columns, in order ---
COLUMNS = [
    "id", "title", "company", "location", "city", "state", "country",
    "work_arrangement", "employment_type", "experience_level",
    "education_level", "years_experience_min", "salary_min", "salary_max",
    "salary_period", "salary_annualized_min", "salary_annualized_max",
    "salary_is_estimated", "visa_sponsorship_mentioned",
    "relocation_mentioned", "urgently_hiring", "date_posted",
    "date_collected", "source", "job_url", "opportunity_score",
    "skills", "benefits", "tags", "research_status", "research_priority",
    "research_notes", "duplicate_count",
]


def _names(array) -> F.Column:
    return F.array_join(F.array_sort(array), "; ")


def export_rows(scope: DataFrame, job_tags: DataFrame | None = None,
                research: DataFrame | None = None,
                custom_values: DataFrame | None = None, custom_fields: dict | None = None,
                include_description: bool = False, max_rows: int | None = None) -> DataFrame:
    """One flat record per job of the scope.

    Bridges are reduced to one row per job before they are joined. ``max_rows``
    is the caller's own limit on the file, applied in job order.
    """
    c = F.col
    if max_rows is not None:
        scope = scope.orderBy("job_id").limit(max_rows)
    df = scope
    if job_tags is not None:
        df = df.join(joined_names(job_tags, "job_id", "tag", "tags"), "job_id", "left")
    else:
        df = df.withColumn("tags", F.lit(""))
    if research is not None:
        df = df.join(research.select(
            "job_id", c("status").alias("_status"), c("priority").alias("research_priority"),
            c("notes").alias("research_notes"), F.lit(True).alias("_noted")),
            "job_id", "left")
    else:
        df = df.withColumns({"_status": F.lit(None).cast("string"),
                             "research_priority": F.lit(None).cast("string"),
                             "research_notes": F.lit(None).cast("string"),
                             "_noted": F.lit(None).cast("boolean")})
    special = {
        "id": c("job_id"), "company": c("company_name_raw"),
        "location": c("location_raw"), "source": c("source_key"),
        "salary_is_estimated": F.coalesce("salary_is_estimated", F.lit(False)),
        "skills": _names(c("skills.name")), "benefits": _names(c("benefits")),
        "tags": F.coalesce("tags", F.lit("")),
        "research_status": F.when(c("_noted"), c("_status")).otherwise("new"),
        "duplicate_count": F.coalesce("duplicate_count", F.lit(0)),
    }
    out = [special.get(x, c(x)).alias(x) for x in COLUMNS]
    if include_description:
        out.append(c("description_text").alias("description"))
    if custom_fields:
        wide = read_values(custom_values, custom_fields, "job", prefix="cf_")
        df = df.join(wide.withColumnRenamed("entity_id", "job_id"), "job_id", "left")
        out += [c(f"cf_{key}") for key in custom_fields]
    return df.select(*out)


def write_export(rows: DataFrame, root: str, fmt: str, log_path: str,
                 as_of: dt.datetime, query: str = "{}") -> tuple[str, int]:
    """Write CSV or JSON lines and append one row to the export log.

    The count is observed while writing, so the rows are computed once. An empty
    result is an error. CSV is UTF-8 without a byte-order mark.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown export format {fmt!r}")
    path = f"{root}/export-{uuid.uuid4().hex}"
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    pattern = "yyyy-MM-dd HH:mm:ss"
    if fmt == "csv":
        nested = [f.name for f in rows.schema.fields
                  if f.dataType.typeName() in ("array", "struct", "map")]
        flat = counted.withColumns({n: F.to_json(n) for n in nested}) if nested else counted
        flat.write.option("header", True).option("timestampFormat", pattern).option(
            "encoding", "UTF-8").csv(path)
    else:
        counted.write.option("timestampFormat", pattern).json(path)
    n = seen.get["n"]
    if n == 0:
        raise ValueError("nothing to export: the filters match no jobs")
    rows.sparkSession.createDataFrame(
        [(as_of, fmt, n, path, query)],
        "at timestamp, format string, rows long, path string, query string"
    ).write.mode("append").parquet(log_path)
    return path, n

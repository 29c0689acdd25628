"""Declarative scoring rules compiled to Columns."""

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.functions import dates

# --- fixed values: the default rules (name, condition, points) ---
DEFAULT_RULES = [
    {"name": "Salary at or above $80k", "points": 20,
     "condition": {"field": "salary_annualized_min", "op": "gte", "value": 80000}},
    {"name": "Remote role", "points": 15,
     "condition": {"field": "work_arrangement", "op": "eq", "value": "remote"}},
    {"name": "Posted within 7 days", "points": 15,
     "condition": {"field": "posting_age_days", "op": "lte", "value": 7}},
    {"name": "Full-time", "points": 10,
     "condition": {"field": "employment_type", "op": "eq", "value": "full_time"}},
    {"name": "Urgently hiring", "points": 10,
     "condition": {"field": "urgently_hiring", "op": "is_true"}},
    {"name": "Company has 5+ open roles", "points": 15,
     "condition": {"field": "company_jobs_discovered", "op": "gte", "value": 5}},
    {"name": "Full description available", "points": 10,
     "condition": {"field": "description_length", "op": "gte", "value": 1500}},
    {"name": "Salary disclosed by employer", "points": 5,
     "condition": {"field": "salary_is_estimated", "op": "is_false"}},
]

_JOB_FACTS = ["title", "city", "state", "work_arrangement", "employment_type",
              "experience_level", "education_level", "years_experience_min",
              "salary_annualized_min", "salary_annualized_max",
              "visa_sponsorship_mentioned", "relocation_mentioned"]


def job_facts(jobs: DataFrame, companies: DataFrame | None, as_of: dt.datetime,
              *keep: str) -> DataFrame:
    """The facts rules may test, one row per job, plus the columns in ``keep``."""
    c = F.col
    facts = jobs.select(
        "job_id", "company_key", *_JOB_FACTS, *keep,
        c("company_name_raw").alias("company"),
        F.coalesce("salary_is_estimated", F.lit(False)).alias("salary_is_estimated"),
        F.coalesce("urgently_hiring", F.lit(False)).alias("urgently_hiring"),
        dates.days_since(c("date_posted"), F.lit(as_of)).alias("posting_age_days"),
        F.char_length(F.coalesce("description_text", F.lit(""))).alias("description_length"),
        F.size("skills").alias("skill_count"), c("skills.name").alias("skills"),
        c("source_key").alias("source"))
    if companies is None:
        return facts.withColumns({
            "company_jobs_discovered": F.lit(0).cast("long"),
            "company_industry": F.lit(None).cast("string"),
            "company_size_estimate": F.lit(None).cast("long"),
            "company_hiring_frequency_30d": F.lit(0.0)})
    about = companies.select(
        "company_key", c("jobs_discovered").alias("_jobs"),
        c("industry").alias("company_industry"),
        c("size_estimate").alias("company_size_estimate"),
        c("hiring_frequency_30d").alias("_frequency"))
    return (facts.join(about, "company_key", "left")
            .withColumn("company_jobs_discovered", F.coalesce("_jobs", F.lit(0)))
            .withColumn("company_hiring_frequency_30d",
                        F.coalesce("_frequency", F.lit(0.0)))
            .drop("_jobs", "_frequency"))


def _kind(dtype) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    return {T.StringType: "text", T.BooleanType: "bool", T.ArrayType: "list",
            T.TimestampType: "time", T.DateType: "time"}.get(type(dtype), "other")


def _kind_of_value(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "text"
    return "list" if isinstance(value, list) else "other"


def _leaf(field: str, op: str, value, schema: T.StructType) -> Column:
    """One comparison, never NULL. Unknown fields count as NULL; comparing
    unlike types is false for orderings and unequal for equality."""
    false, true = F.lit(False), F.lit(True)
    known = field in schema.fieldNames()
    kind = _kind(schema[field].dataType) if known else "null"
    a = F.col(field) if known else F.lit(None).cast("string")
    comparable = kind == _kind_of_value(value) and kind in ("number", "text", "bool")

    def two_valued(condition):
        return F.coalesce(condition, false)

    if op in ("is_true", "is_false"):
        return two_valued(a == F.lit(op == "is_true")) if kind == "bool" else false
    if op == "is_null":
        return a.isNull()
    if op == "is_not_null":
        return a.isNotNull()
    if op in ("eq", "ne"):
        if value is None:
            same = a.isNull()
        else:
            same = two_valued(a == F.lit(value)) if comparable else false
        return same if op == "eq" else ~same
    if op in ("gt", "gte", "lt", "lte"):
        if not comparable:
            return false
        return two_valued({"gt": a > value, "gte": a >= value,
                           "lt": a < value, "lte": a <= value}[op])
    if op in ("contains", "not_contains"):
        needle = str(value).lower()
        if kind == "list":
            hit = two_valued(F.exists(a, lambda x: F.contains(F.lower(x), F.lit(needle))))
        elif kind == "null":
            hit = false
        else:
            shown = F.lower(a.cast("string"))
            hit = two_valued(F.contains(shown, F.lit(needle)))
            if kind == "text":
                hit &= two_valued(a != "")
            elif kind in ("number", "bool"):
                hit &= two_valued(a.cast("double") != 0)
        return hit if op == "contains" else ~hit
    if op in ("in", "not_in"):
        if kind == "list" and op == "in":
            needle = str(value).lower()
            return two_valued(F.exists(a, lambda x: F.contains(F.lower(x), F.lit(needle))))
        options = value or []
        if not isinstance(options, list):
            return false
        like = [v for v in options if _kind_of_value(v) == kind]
        hit = two_valued(a.isin(like)) if like else false
        if any(v is None for v in options):
            hit = hit | a.isNull()
        return hit if op == "in" else ~hit
    return false


def compile_condition(condition, schema: T.StructType) -> Column:
    """JSON condition to a two-valued Column; anything malformed is false."""
    if not isinstance(condition, dict):
        return F.lit(False)
    for word, start, join in (("all", True, lambda x, y: x & y),
                              ("any", False, lambda x, y: x | y)):
        if word in condition:
            result = F.lit(start)
            for part in condition[word]:
                result = join(result, compile_condition(part, schema))
            return result
    if "not" in condition:
        return ~compile_condition(condition["not"], schema)
    if condition.get("field") is None:
        return F.lit(False)
    return _leaf(condition["field"], condition.get("op", "eq"),
                 condition.get("value"), schema)


def score(rules: list[dict], schema: T.StructType) -> Column:
    """0-100 with one decimal; NULL without an active job rule of any weight.

    A rule whose condition text is not JSON still counts towards the maximum.
    """
    active = [r for r in rules if r.get("is_active", True)
              and r.get("entity", "job") == "job"]
    earned, possible = F.lit(0.0), 0.0
    for rule in active:
        weight = 1.0 if rule.get("weight") is None else float(rule["weight"])
        points = float(rule.get("points") or 0.0) * weight
        possible += abs(points)
        condition = rule["condition"]
        if isinstance(condition, str):
            try:
                condition = json.loads(condition)
            except json.JSONDecodeError:
                continue
        earned += F.when(compile_condition(condition, schema),
                         F.lit(points)).otherwise(0.0)
    if possible <= 0:
        return F.lit(None).cast("double")
    share = 100.0 * earned / F.lit(possible)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)), 1)


def rescore(jobs: DataFrame, companies: DataFrame | None, rules: list[dict],
            as_of: dt.datetime, only: DataFrame | None = None) -> DataFrame:
    """(job_id, opportunity_score) of all jobs or of the ids in ``only``."""
    if only is not None:
        jobs = jobs.join(only.select("job_id"), "job_id", "left_semi")
    facts = job_facts(jobs, companies, as_of)
    return facts.select("job_id", score(rules, facts.schema).alias("opportunity_score"))


def _tenths(value: Column) -> Column:
    """One decimal, halves up. Sums of shares miss a half by the last bit (54.349999999999994
    for 54.35); ten times the value is that half again, while a plain round would go down."""
    return F.round(value * 10.0) / 10.0


def score_companies(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """(company_key, opportunity_score) from open primary postings."""
    paid = F.when(F.col("salary_annualized_min") != 0, F.col("salary_annualized_min"))
    stats = (jobs.where(F.col("is_active") & F.col("is_primary"))
             .groupBy("company_key").agg(
                 F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("work_arrangement") == "remote").alias("remote"),
                 F.count(paid).alias("paid"), F.avg(paid).alias("mean_pay")))
    n = F.col("n")
    total = (F.least(F.lit(40.0), n * 4.0) + F.col("remote") / n * 20.0
             + F.col("paid") / n * 10.0
             + F.coalesce(F.least(F.lit(20.0), F.col("mean_pay") / 6000.0), F.lit(0.0))
             + F.least(F.lit(10.0),
                       F.coalesce("hiring_frequency_30d", F.lit(0.0)) * 2.0))
    return (companies.select("company_key", "hiring_frequency_30d")
            .join(stats, "company_key", "left")
            .select("company_key", F.coalesce(
                _tenths(F.least(F.lit(100.0), total)), F.lit(0.0))
                .alias("opportunity_score")))

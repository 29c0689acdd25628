"""Reference data kept as files: seed employers and the skills taxonomy."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.functions.text import clean, normalize_company

_SEED = "name string, domain string, industry string, ats_platform string, " \
        "ats_board_token string"


def read_seed_companies(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of employers: trimmed, blanks NULL, nameless rows dropped."""
    raw = spark.read.schema(_SEED).option("header", True).csv(path)
    return clean_seed_companies(raw)


def clean_seed_companies(raw: DataFrame) -> DataFrame:
    names = ["name", "domain", "industry", "ats_platform", "ats_board_token"]
    rows = raw.select(*[clean(F.col(n)).alias(n) for n in names]).where(
        "name is not null")
    return rows.withColumn("company_key", normalize_company(F.col("name")))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{category, name, aliases}``, in priority order."""
    rows = spark.read.schema("category string, name string, aliases array<string>").json(
        path)
    return (rows.withColumn("skill_id", F.monotonically_increasing_id())
            .withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
            .select("skill_id", "name", "category", "aliases"))

"""Enriched jobs at rest: text work runs once, at the write."""

from pyspark.sql import DataFrame


def save_jobs(jobs: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write enriched jobs to a folder all executors share and read them back.

    Readers see plain columns: unused ones are never read and predicates, also
    those on derived fields, are pushed into the Parquet scan."""
    jobs.write.mode(mode).parquet(path)
    return jobs.sparkSession.read.schema(jobs.schema).parquet(path)

"""Closed-vocabulary labels read out of text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill import vocab
from rolemill.functions.clues import rlike
from rolemill.functions.text import blob, first_label, opening


def work_arrangement(*texts: Column) -> Column:
    """hybrid, remote, onsite or unknown; "no remote" means onsite."""
    text = blob(*texts)
    return (F.when(rlike(text, vocab.HYBRID), "hybrid")
            .when(rlike(text, vocab.REMOTE),
                  F.when(rlike(text, vocab.NOT_REMOTE), "onsite").otherwise("remote"))
            .when(rlike(text, vocab.ONSITE), "onsite")
            .otherwise("unknown"))


def resolve_arrangement(detected: Column, is_remote: Column) -> Column:
    """Text saying hybrid wins, then the source's flag, then other text."""
    return (F.when(detected == "hybrid", "hybrid")
            .when(is_remote, "remote")
            .otherwise(detected))


def employment_type(*texts: Column) -> Column:
    return first_label(blob(*texts), vocab.EMPLOYMENT_PATTERNS)


def experience_level(title: Column, description: Column, years_min: Column,
                     window: int | None = None) -> Column:
    """Title wording, then required years, then the description or its opening."""
    by_years = (F.when(years_min >= 8, "senior")
                .when(years_min >= 3, "mid")
                .when(years_min >= 0, "entry"))
    return F.coalesce(
        first_label(F.lower(title), vocab.LEVEL_PATTERNS),
        by_years,
        first_label(F.lower(opening(description, window)),
                    vocab.LEVEL_PATTERNS))


def education_level(text: Column, window: int | None = None) -> Column:
    return first_label(F.lower(opening(text, window)), vocab.EDUCATION_PATTERNS)

"""Salary parsing, annualising and banding."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill import vocab
from rolemill.functions.binding import let
from rolemill.functions.text import first_label, opening

_PAY = "struct<salary_min:double,salary_max:double,salary_period:string>"


def guess_period(value: Column, text: Column) -> Column:
    """Pay period from wording near the amount, else from its size."""
    by_size = F.when(value.isNull(), "yearly")
    for name, ceiling in vocab.PERIOD_CEILINGS:
        by_size = by_size.when(value < ceiling, name)
    return let(F.lower(text), lambda low: F.coalesce(
        first_label(low, vocab.PERIOD_HINTS), by_size.otherwise("yearly")))


def salary_match(text: Column, window: int | None = None) -> Column:
    """The first dollar amount or range as written; empty when there is none."""
    return F.regexp_extract(opening(text, window), vocab.SALARY_AMOUNT, 0)


def _amount(match: Column, group: int) -> Column:
    digits = F.regexp_extract(match, vocab.SALARY_AMOUNT, group)
    number = F.nullif(F.replace(digits, F.lit(","), F.lit("")), F.lit("")).try_cast("double")
    return F.when(F.regexp_extract(match, vocab.SALARY_AMOUNT, group + 1) != "",
                  number * 1000).otherwise(number)


def parse_salary(text: Column, match: Column | None = None) -> Column:
    """First dollar amount or range in the text, with its period, else NULL.

    ``match`` is ``salary_match(text)`` when the caller already has it as a
    column; the groups are read from that short string.
    """
    def found(m):
        start = F.position(m, text)
        left = F.greatest(F.lit(1), start - 60)
        return F.struct(
            _amount(m, 1).alias("low"), _amount(m, 3).alias("high"),
            F.substring(text, left, start + F.char_length(m) + 60 - left)
            .alias("nearby"))

    def pay(v):
        return F.struct(
            F.least(v["low"], v["high"]).alias("salary_min"),
            F.when(v["high"].isNotNull(), F.greatest(v["low"], v["high"]))
            .alias("salary_max"),
            guess_period(v["low"], v["nearby"]).alias("salary_period"))

    match = salary_match(text) if match is None else match
    return let(match, lambda m: F.when(m != "", let(found(m), pay)))


def fold_period(period: Column) -> Column:
    p = F.lower(F.coalesce(F.nullif(period, F.lit("")), F.lit("yearly")))
    return F.when(p.isin(vocab.YEARLY_SYNONYMS), "yearly").otherwise(p)


def annualize(value: Column, period: Column) -> Column:
    """Value per year, two decimals; an unknown period counts once."""
    rates = F.create_map(*[F.lit(x) for x in chain.from_iterable(
        vocab.PERIODS_PER_YEAR.items())])
    p = F.lower(F.coalesce(F.nullif(period, F.lit("")), F.lit("yearly")))
    return F.round(value * F.coalesce(F.try_element_at(rates, p), F.lit(1.0)), 2)


def resolve_salary(salary_min: Column, salary_max: Column, period: Column,
                   currency: Column, is_estimated: Column, from_text: Column) -> Column:
    """One salary struct: structured fields when given, else ``from_text``.

    A posting without any pay counts as "not estimated".
    """
    structured = (F.coalesce(salary_min, F.lit(0.0)) != 0) | (
        F.coalesce(salary_max, F.lit(0.0)) != 0)
    chosen = F.when(structured, F.struct(
        salary_min.cast("double").alias("salary_min"),
        salary_max.cast("double").alias("salary_max"),
        fold_period(period).alias("salary_period"))).otherwise(
            from_text).cast(_PAY)
    return F.struct(
        chosen["salary_min"].alias("salary_min"),
        chosen["salary_max"].alias("salary_max"),
        chosen["salary_period"].alias("salary_period"),
        F.when(structured, F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD")))
        .otherwise("USD").alias("salary_currency"),
        (structured & F.coalesce(is_estimated, F.lit(False)))
        .alias("salary_is_estimated"))


def salary_band(value: Column) -> Column:
    """Band label of an annual amount; NULL stays NULL."""
    band = F.when(value < vocab.SALARY_BANDS[0][1], vocab.SALARY_BANDS[0][0])
    for label, ceiling in vocab.SALARY_BANDS[1:]:
        band = band.when(value < ceiling, label)
    return F.when(value.isNotNull(), band.otherwise("Unknown"))


def salary_band_order(value: Column) -> Column:
    order = F.when(value < vocab.SALARY_BANDS[0][1], 0)
    for i, (_, ceiling) in enumerate(vocab.SALARY_BANDS[1:], start=1):
        order = order.when(value < ceiling, i)
    return F.when(value.isNotNull(), order.otherwise(99))

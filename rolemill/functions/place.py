"""Location parsing."""

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill import vocab
from rolemill.functions.binding import let
from rolemill.functions.clues import holds
from rolemill.functions.text import strip


def _lookup(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


# A text without any of these holds none of ``US_WORDS``.
_US_CLUES = ["united states", "usa", "u.s."]


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _may_hold_zip(raw: Column) -> Column:
    """False only without five digits. Regexes slow each other down across threads, so none
    is used to tell."""
    return F.char_length(raw) - F.char_length(F.translate(raw, "0123456789", "")) >= 5


def _unzipped(raw: Column) -> Column:
    return F.when(_may_hold_zip(raw), F.regexp_replace(raw, vocab.ZIP_CODE, "")).otherwise(raw)


def _bare(place: Column) -> Column:
    """A place text without the country, from the first to the last character that belongs
    to a part between commas."""
    named = holds(F.lower(place), _US_CLUES)
    return F.trim(F.when(named, F.regexp_replace(place, vocab.US_WORDS, "")).otherwise(place), F.lit(" ,-"))


def _state(bare: Column) -> Column:
    tail = F.trim(F.substring_index(bare, ",", -1), F.lit(" ,-"))
    return F.when(
        F.upper(tail).isin(list(vocab.US_STATES.values())), F.upper(tail)
    ).otherwise(F.try_element_at(_lookup(vocab.US_STATES), F.lower(tail)))


def _city(bare: Column, state: Column) -> Column:
    # Both ends of ``bare`` belong to parts, so a comma in it means two parts at least.
    head = F.trim(F.substring_index(bare, ",", 1), F.lit(" ,-"))
    has_city = F.when(state.isNotNull(), F.contains(bare, F.lit(","))).otherwise(bare != "")
    return F.when(has_city & ~F.lower(head).isin(vocab.NOT_A_CITY), head)


def _postal(raw: Column) -> Column:
    return F.when(_may_hold_zip(raw), F.nullif(F.regexp_extract(raw, vocab.ZIP_CODE, 1), F.lit("")))


def parse_location(c: Column) -> Column:
    """Struct (city, state, country, postal_code) from free text."""
    def read(raw):
        return let(let(_unzipped(raw), _bare), lambda bare: let(_state(bare), lambda state: F.struct(
            _city(bare, state).alias("city"), state.alias("state"), F.lit("US").alias("country"),
            _postal(raw).alias("postal_code"))))

    return let(strip(F.coalesce(c, F.lit(""))), read)


def with_place(df: DataFrame) -> DataFrame:
    """Columns city, state, country and postal_code: structured place first; free text
    (``location_raw``) only fills what is missing.

    Each intermediate value is a column of its own, so that the fields share it within
    generated code; a field nobody selects is not computed."""
    raw, place, bare, state = (f"_place_{x}" for x in ("raw", "place", "bare", "state"))
    c = F.col
    incomplete = (_blank(c("city")) | _blank(c("state"))) & ~_blank(c("location_raw"))
    # NULL where the text is not read.
    df = df.withColumn(raw, F.when(incomplete, strip("location_raw")))
    df = df.withColumn(place, _unzipped(c(raw)))
    df = df.withColumn(bare, _bare(c(place)))
    df = df.withColumn(state, _state(c(bare)))

    def filled(name, parsed):
        return F.when(c(raw).isNotNull(), F.coalesce(F.nullif(name, F.lit("")), parsed)).otherwise(c(name))

    return df.withColumns({
        "city": filled("city", _city(c(bare), c(state))), "state": filled("state", c(state)),
        "country": F.coalesce(F.nullif("country", F.lit("")), F.lit("US")),
        "postal_code": filled("postal_code", _postal(c(raw)))}).drop(raw, place, bare, state)


def display_location(location_raw: Column, city: Column, state: Column) -> Column:
    """Raw location, else "city, state", else NULL."""
    pair = F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(state, F.lit("")))
    return F.coalesce(F.nullif(location_raw, F.lit("")), F.nullif(pair, F.lit("")))

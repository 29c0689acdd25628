"""Date parsing and posting age."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.binding import let

_NAMES = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? +)?"
_NAME = rf"({_NAMES})[a-z]*\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
# Hours, minutes, seconds, fraction, half of the day, zone; all of it may be missing.
_TIME = (r"(?:(?:t|[ ,]+(?:at +)?)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)? *"
         r"([ap]\.?m\.?)? *(z|utc|gmt|[+-]\d{2}:?\d{2})?(?: *\([a-z]+\))?)?$")
# Each spelling has one shape; the numbers say which group is year, month and day.
# Zone-less values are UTC because sessions run in UTC.
SHAPES = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME, (1, 2, 3)),
    (r"^(\d{4})(\d{2})(\d{2})" + _TIME, (1, 2, 3)),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _TIME, (3, 1, 2)),
    (rf"^{_WEEKDAY}{_NAME} +{_DAY},? +(\d{{4}})" + _TIME, (3, 1, 2)),
    (rf"^{_WEEKDAY}{_DAY}[ -]+(?:of +)?{_NAME},?[ -]+(\d{{4}})" + _TIME, (3, 2, 1)),
]
# The commonest spelling. Spark reads it as it is, without taking it to pieces.
_PLAIN = r"^\d{4}-\d{2}-\d{2}t\d{2}:\d{2}:\d{2}z?$"
_EPOCH = r"^-?\d{9,14}(\.\d+)?$"
# Epoch numbers above this are milliseconds (as seconds: the year 5138).
_MILLIS_FROM = 1e11


def parse_epoch(c: Column) -> Column:
    """Epoch seconds or milliseconds to a timestamp; zero and NULL give NULL."""
    seconds = F.when(F.abs(c) > _MILLIS_FROM, c / 1000.0).otherwise(
        c.cast("double"))
    return F.when((c != 0) & (F.abs(seconds) < 2.5e11),
                  F.timestamp_seconds(seconds))


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _read(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    """The timestamp of a text of this shape; NULL if it names no moment."""
    def part(i):
        return F.regexp_extract(text, pattern, i)

    def written(p):
        month = F.coalesce(_number(p["month"]), F.ceil(F.position(
            F.substring(p["month"], 1, 3), F.lit(_NAMES.replace("|", ""))) / 3).cast("int"))
        day = _number(p["day"])
        # Month first, unless that number can only be a day.
        swapped = F.lit(order == (3, 1, 2)) & (month > 12) & (day <= 12)
        late, hour = p["half"].startswith("p"), F.coalesce(_number(p["hour"]), F.lit(0))
        hour = F.when(p["half"] == "", hour).when(hour.between(1, 12), hour % 12 + F.when(
            late, 12).otherwise(0))
        zone = F.when(p["zone"].rlike("^[+-]"), F.regexp_replace(
            p["zone"], r"^(.\d{2}):?(\d{2})$", "$1:$2")).otherwise("Z")
        return F.concat(
            p["year"], F.lit("-"), F.lpad(F.when(swapped, day).otherwise(month).cast("string"), 2, "0"),
            F.lit("-"), F.lpad(F.when(swapped, month).otherwise(day).cast("string"), 2, "0"), F.lit("T"),
            F.lpad(hour.cast("string"), 2, "0"), F.lit(":"),
            F.coalesce(F.nullif(p["minute"], F.lit("")), F.lit("00")), F.lit(":"),
            F.coalesce(F.nullif(p["second"], F.lit("")), F.lit("00")), F.lit("."),
            F.rpad(F.substring(p["fraction"], 1, 6), 6, "0"), zone)

    names = ("hour", "minute", "second", "fraction", "half", "zone")
    parts = F.struct(*[part(i).alias(n) for i, n in zip(order, ("year", "month", "day"))],
                     *[part(i).alias(n) for i, n in enumerate(names, 4)])
    return let(parts, lambda p: written(p).try_cast("timestamp"))


def parse_date(c: Column) -> Column:
    """Text to a UTC timestamp, NULL when unreadable. Plain numbers of nine digits and
    more are epochs. A text is classified once and read in the way of its one shape."""
    text = F.lower(F.regexp_replace(F.trim(c.cast("string")), r"\s+", " "))

    def read(t):
        out = F.when(t.rlike(_PLAIN), F.concat(F.upper(F.substring(t, 1, 19)), F.lit("Z")).try_cast("timestamp"))
        # No text of this kind has any of the shapes.
        out = out.when(t.rlike(_EPOCH), let(t.try_cast("double"), parse_epoch))
        for pattern, order in SHAPES:
            out = out.when(t.rlike(pattern), _read(t, pattern, order))
        return out

    return let(text, read)


def days_since(c: Column, as_of: Column) -> Column:
    """Whole days from ``c`` to ``as_of``, never negative."""
    elapsed = F.floor((F.unix_micros(as_of.cast("timestamp"))
                       - F.unix_micros(c.cast("timestamp")))
                      / F.lit(86400000000))
    return F.when(c.isNotNull(), F.greatest(F.lit(0).cast("long"), elapsed.cast("long")))

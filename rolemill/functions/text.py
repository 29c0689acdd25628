"""Text clean-up and name normalisation as Column expressions."""

import html
import string
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill import vocab
from rolemill.functions import clues

# The entities the JVM path decodes; anything else goes through the Arrow UDF.
_NATIVE_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                    ("&#39;", "'"), ("&nbsp;", "\u00a0"),
                    ("&copy;", "©"), ("&middot;", "·")]
_OTHER_ENTITY = r"&(?!(lt|gt|quot|#39|nbsp|copy|middot|amp);)[#A-Za-z]"
# Characters with the Unicode property White_Space.
_SPACES = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
           + "\u2028\u2029\u202f\u205f\u3000")
# Blank runs but the single space, which needs no replacing.
_WIDE_RUN = r"[\t\r\f\x0B][ \t\r\f\x0B]*| [ \t\r\f\x0B]+"


@F.pandas_udf(T.StringType())
def _unescape_rare(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def strip(c: Column) -> Column:
    """Trim every kind of whitespace at both ends."""
    return F.trim(c, F.lit(_SPACES))


def clean(c: Column) -> Column:
    """String, stripped; empty becomes NULL."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def unescape_entities(c: Column) -> Column:
    """Decode HTML entities once.

    Texts holding only the common entities are decoded by built-in replaces,
    ``&amp;`` last so nothing is decoded twice. Only texts with another entity
    are shipped to Python; the others travel as NULL.
    """
    encoded = F.contains(c, F.lit("&"))
    rare = encoded & c.rlike(_OTHER_ENTITY)
    native = c
    for entity, char in _NATIVE_ENTITIES:
        native = F.replace(native, F.lit(entity), F.lit(char))
    native = F.replace(native, F.lit("&amp;"), F.lit("&"))
    return F.coalesce(_unescape_rare(F.when(rare, c)), F.when(encoded, native).otherwise(c))


def strip_tags(c: Column) -> Column:
    """Block ends become newlines, list items dashes, other tags spaces."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), vocab.BREAK_TAG, "\n")
    text = F.regexp_replace(text, vocab.LIST_ITEM_TAG, "\n- ")
    return F.regexp_replace(text, vocab.ANY_TAG, " ")


def tidy(c: Column) -> Column:
    """Collapse blanks, allow at most one empty line, strip."""
    text = F.regexp_replace(c, _WIDE_RUN, " ")
    return strip(F.regexp_replace(text, vocab.NEWLINE_RUN, "\n\n"))


def html_to_text(c: Column, unescape_first: bool = False) -> Column:
    """Readable text of an HTML body; NULL gives an empty string.

    Tags go before entities are decoded, so markup that was itself escaped
    survives as text; ``unescape_first`` removes that markup too.
    """
    if unescape_first:
        return tidy(strip_tags(unescape_entities(F.coalesce(c, F.lit("")))))
    return tidy(unescape_entities(strip_tags(c)))


# Rows cleaned at once, which bounds the copies a worker holds.
_SLICE_ROWS = 512


def _linear(pattern: str) -> str:
    """The pattern for Arrow's engine, whose ``\\s`` lacks the vertical tab."""
    return pattern.replace(r"\s", r"[\t\n\x0B\f\r ]")


def _readable(texts: pa.Array) -> pa.Array:
    """``html_to_text`` of a few texts, a vectorised pass a step."""
    bare = pc.fill_null(texts, "")
    for pattern, by in ((vocab.BREAK_TAG, "\n"), (vocab.LIST_ITEM_TAG, "\n- "), (vocab.ANY_TAG, " ")):
        bare = pc.replace_substring_regex(bare, _linear(pattern), by)
    encoded = pc.match_substring(bare, "&")
    if pc.any(encoded).as_py():
        decoded = [html.unescape(t) for t in bare.filter(encoded).to_pylist()]
        bare = pc.replace_with_mask(bare, encoded, pa.array(decoded, bare.type))
    for pattern, by in ((_WIDE_RUN, " "), (vocab.NEWLINE_RUN, "\n\n")):
        bare = pc.replace_substring_regex(bare, pattern, by)
    return pc.utf8_trim(bare, _SPACES)


@F.arrow_udf(T.StringType())
def _html_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.concat_arrays([_readable(texts.slice(at, _SLICE_ROWS))
                                for at in range(0, max(len(texts), 1), _SLICE_ROWS)])


def with_text(df: DataFrame, html_column: str, into: str) -> DataFrame:
    """``html_to_text`` in one Arrow step: its seven searches a text cost far more as
    expressions than the way to Python and back."""
    return df.withColumn(into, _html_text(html_column))


# Runs of what ``vocab.COMPANY_OTHER`` and ``vocab.TITLE_OTHER`` replace, and of blanks. All
# characters are written out: Java reads such a class as one table, but one of ranges and ``\s``
# as a chain of tests, some thirty times slower when many threads search.
_NAME_CHARACTERS = string.ascii_lowercase + string.digits
_COMPANY_GAP = f"[^{_NAME_CHARACTERS}&.-]+"
_TITLE_GAP = f"[^{_NAME_CHARACTERS}+#/-]+"


def normalize_company(c: Column) -> Column:
    """Employer name without case, punctuation and legal-form words.

    Legal-form words drop wherever they stand. A name made of nothing else
    falls back to its lowered form; NULL gives an empty string.
    """
    name = F.coalesce(c, F.lit(""))
    s = F.translate(strip(F.lower(name)), vocab.COMPANY_QUOTES.strip("[]"), "")
    s = F.regexp_replace(s, _COMPANY_GAP, " ")
    suffixes = F.array(*[F.lit(x) for x in vocab.LEGAL_SUFFIXES])
    words = F.filter(
        F.split(s, " "),
        lambda w: (w != "") & ~F.array_contains(suffixes, F.trim(w, F.lit("."))))
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")),
                      strip(F.lower(name)))


def normalize_title(c: Column) -> Column:
    """Job title without bracketed text, advertising phrases and punctuation."""
    s = F.lower(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(s, vocab.TITLE_BRACKETED, " ")
    s = F.regexp_replace(s, "(?i)" + vocab.TITLE_NOISE, " ")
    return F.trim(F.regexp_replace(s, _TITLE_GAP, " "), F.lit(" -/"))


def summarize(c: Column, limit: int = vocab.SUMMARY_LENGTH) -> Column:
    """One-line preview: cut at ``limit``, drop the broken last word."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, limit), " [^ ]*$", "")
    return (F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string"))
            .when(F.char_length(flat) <= limit, flat)
            .otherwise(F.concat(cut, F.lit("..."))))


def blob(*parts: Column) -> Column:
    """Lower-cased space-joined text of the non-empty parts."""
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def first_label(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Label of the first pattern that occurs in the lower-case ``text``, else NULL."""
    label = F.when(clues.rlike(text, patterns[0][1]), patterns[0][0])
    for name, pattern in patterns[1:]:
        label = label.when(clues.rlike(text, pattern), name)
    return label


def contains_text(c: Column, needle: str) -> Column:
    """Case-insensitive literal containment (wildcards have no meaning)."""
    return F.contains(F.lower(c), F.lower(F.lit(needle)))


def opening(value: Column, window: int | None) -> Column:
    """The first ``window`` characters, or the whole text without one."""
    return value if window is None else F.substring(value, 1, window)

"""Facts read out of posting text."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill import vocab
from rolemill.functions import clues
from rolemill.functions.binding import let
from rolemill.functions.text import opening

# YEARS_SINGLE without its optional words in front, which no group keeps: they made the
# search try them at every character. The figures found are the same.
_YEARS_FIGURE = r"(?i)(\d{1,2})\s*\+?\s*(?:years?|yrs?)"
# Stands in every match of PHONE; unlike that it is tried at digits only.
_PHONE_END = r"\d{3}[\s.-]\d{4}"


def experience_years(text: Column, window: int | None = None) -> Column:
    """Struct (years_experience_min, years_experience_max).

    A credible range wins; else the smallest single figure; else a number word.
    """
    words = F.create_map(*[F.lit(x) for x in chain.from_iterable(
        (w, i) for i, w in enumerate(vocab.NUMBER_WORDS, start=1))])

    def smallest(window):
        singles = F.filter(
            F.transform(F.regexp_extract_all(window, F.lit(_YEARS_FIGURE),
                                             F.lit(1)), lambda x: x.cast("int")),
            lambda y: (y > 0) & (y <= 30))
        word = F.regexp_extract(window, r"(?i)\b(" + "|".join(vocab.NUMBER_WORDS) +
                                r")\s*\+?\s*(?:years?|yrs?)", 1)
        return F.coalesce(F.array_min(singles),
                          F.try_element_at(words, F.lower(word)))

    def bounds(m):
        return F.struct(
            F.nullif(F.regexp_extract(m, vocab.YEARS_RANGE, 1), F.lit("")).try_cast("int").alias("low"),
            F.nullif(F.regexp_extract(m, vocab.YEARS_RANGE, 2), F.lit("")).try_cast("int").alias("high"))

    def pick(window):
        def result(b):
            ranged = F.coalesce((b["low"] <= 40) & (b["low"] <= b["high"])
                                & (b["high"] <= 40), F.lit(False))
            return F.struct(
                F.when(ranged, b["low"]).otherwise(smallest(window)).cast("int")
                .alias("years_experience_min"),
                F.when(ranged, b["high"]).alias("years_experience_max"))
        return let(bounds(F.regexp_extract(window, vocab.YEARS_RANGE, 0)), result)

    none = F.lit(None).cast("int")
    part = opening(text, window)
    return F.when(clues.may_match(F.lower(part), vocab.YEARS_SINGLE), let(part, pick)).otherwise(
        F.struct(none.alias("years_experience_min"), none.alias("years_experience_max")))


def benefits(text: Column) -> Column:
    """Array of benefit labels mentioned, in fixed order."""
    def found(low):
        return F.array(*[F.when(clues.rlike(low, p), F.lit(name))
                         for name, p in vocab.BENEFIT_PATTERNS])

    return F.filter(let(F.lower(F.coalesce(text, F.lit(""))), found), lambda x: x.isNotNull())


def flag_text(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"),
                    F.coalesce(text, F.lit("")))


def _yes_no(text: Column, yes: str, no: str) -> Column:
    low = F.lower(text)
    return F.when(clues.rlike(text, no, low), F.lit(False)).when(
        clues.rlike(text, yes, low), F.lit(True))


def sponsorship(text: Column) -> Column:
    return _yes_no(text, vocab.SPONSOR_YES, vocab.SPONSOR_NO)


def relocation(text: Column) -> Column:
    return _yes_no(text, vocab.RELOCATION_YES, vocab.RELOCATION_NO)


def urgently_hiring(text: Column) -> Column:
    """True or NULL, never false."""
    return F.when(clues.rlike(text, vocab.URGENT, F.lower(text)), F.lit(True))


def recruitment_agency(text: Column) -> Column:
    return F.coalesce(clues.rlike(text, vocab.AGENCY, F.lower(text)), F.lit(False))


def _distinct_matches(text: Column, pattern: str, possible: Column, keep: int | None) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.when(possible, F.array_sort(F.array_distinct(hits))).otherwise(
        F.array().cast("array<string>"))
    return found if keep is None else F.slice(found, 1, keep)


def contacts(text: Column, keep: int | None = None) -> Column:
    """Struct of distinct, sorted e-mail addresses and phone numbers, all of them or
    the first ``keep``."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(
        _distinct_matches(text, vocab.EMAIL, clues.may_match(text, vocab.EMAIL), keep).alias("emails"),
        _distinct_matches(text, vocab.PHONE, text.rlike(_PHONE_END), keep).alias("phones"))


def detect_board(url: Column) -> Column:
    """Struct (platform, token) when the URL belongs to a known board host."""
    def piece(name):
        return F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))

    def usable(token):
        return F.when((token != "") & ~F.lower(token).isin(vocab.BOARD_RESERVED),
                      token)

    def platform_of(u):
        platform = F.when(F.lit(False), F.lit(""))
        for host_pattern, name, _ in vocab.BOARD_HOSTS:
            platform = platform.when(u["host"].rlike(host_pattern), name)
        return platform

    def token_of(u, platform):
        token = F.when(F.lit(False), F.lit(""))
        for _, name, path_pattern in vocab.BOARD_HOSTS:
            if path_pattern:
                token = token.when(platform == name,
                                   F.regexp_extract(u["path"], path_pattern, 1))
        sub = F.substring_index(u["host"], ".", 1)
        query = F.regexp_extract(u["query"], r"for=([A-Za-z0-9_-]+)", 1)
        return F.when(platform == "recruitee", usable(sub)).otherwise(F.coalesce(
            F.nullif(query, F.lit("")), let(token, usable),
            F.when(~sub.isin(vocab.BOARD_SUBDOMAINS_SKIPPED), usable(sub))))

    def board(platform, token):
        return F.when(token.isNotNull(), F.struct(platform.alias("platform"),
                                                  token.alias("token")))

    parts = F.struct(F.lower(piece("HOST")).alias("host"),
                     piece("PATH").alias("path"), piece("QUERY").alias("query"))
    return let(parts, lambda u: let(platform_of(u), lambda p: F.when(
        p.isNotNull(), let(token_of(u, p), lambda t: board(p, t)))))

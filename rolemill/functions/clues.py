"""Clues: literal words one of which stands in every match of a pattern.

Most patterns of ``vocab`` occur in few texts, and looking for a literal costs a small
part of a regex search. ``rlike`` searches a text only if it holds a clue; the outcome
is that of the plain search, since every match contains a clue (a test writes out all
alternatives of every pattern and checks them). Clues are in lower case and are looked
for in the lower-cased text.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill import vocab

_LABELS = dict(vocab.EMPLOYMENT_PATTERNS + vocab.LEVEL_PATTERNS + vocab.EDUCATION_PATTERNS
               + vocab.BENEFIT_PATTERNS)
_HINTS = dict(vocab.PERIOD_HINTS)

# --- fixed values: pattern -> its clues ---
CLUES = {
    vocab.HYBRID: ["hybrid"],
    vocab.REMOTE: ["remote", "work from home", "telecommut", "wfh"],
    vocab.NOT_REMOTE: ["remote"],
    vocab.ONSITE: ["site", "in office", "in-office", "in person", "in-person"],
    _LABELS["internship"]: ["intern", "co-op", "co op"],
    _LABELS["temporary"]: ["temp", "seasonal", "locum"],
    _LABELS["contract"]: ["contract", "freelance", "1099", "c2c", "corp"],
    _LABELS["part_time"]: ["part", "prn"],
    _LABELS["full_time"]: ["full", "permanent", "regular"],
    _LABELS["executive"]: ["chief", "ceo", "cto", "coo", "cfo", "cio", "vp", "president",
                           "executive vice"],
    _LABELS["director"]: ["director", "head of"],
    _LABELS["manager"]: ["manager", "supervisor", "team lead"],
    _LABELS["senior"]: ["senior", "sr", "staff", "principal", "lead", "iii", "iv"],
    _LABELS["entry"]: ["entry", "junior", "jr", "associate", "trainee", "graduate",
                       "apprentice", "intern"],
    _LABELS["doctorate"]: ["phd", "ph.d", "doctora", "doctorate"],
    _LABELS["masters"]: ["master", "graduate degree", "ms", "m.s", "mba", "m.ba", "mb.a", "m.b.a"],
    _LABELS["bachelors"]: ["bachelor", "undergraduate degree", "year degree", "bs", "b.s",
                           "ba", "b.a"],
    _LABELS["associates"]: ["associate", "year degree", "aa", "a.a"],
    _LABELS["certification"]: ["certifi", "cpc", "ccs", "rhia", "rhit"],
    _LABELS["high_school"]: ["high school", "ged", "hs diploma"],
    _LABELS["health_insurance"]: ["health ", "medical"],
    _LABELS["dental"]: ["dental"],
    _LABELS["vision"]: ["vision "],
    _LABELS["retirement_401k"]: ["401", "403", "retirement plan", "pension"],
    _LABELS["paid_time_off"]: ["pto", "paid ", "vacation days", "annual leave"],
    _LABELS["paid_holidays"]: ["paid holiday"],
    _LABELS["parental_leave"]: ["ternity leave", "parental leave"],
    _LABELS["remote_stipend"]: ["stipend", "internet reimbursement"],
    _LABELS["tuition_reimbursement"]: ["tuition ", "education "],
    _LABELS["bonus"]: ["bonus"],
    _LABELS["equity"]: ["equity", "stock options", "rsu", "espp"],
    _LABELS["life_insurance"]: ["life insurance"],
    _LABELS["disability"]: ["term disability", "std/ltd"],
    _LABELS["flexible_schedule"]: ["flex"],
    _LABELS["professional_development"]: ["professional development", "learning budget",
                                          "conference budget"],
    vocab.SPONSOR_YES: ["sponsor"],
    vocab.SPONSOR_NO: ["sponsor"],
    vocab.RELOCATION_YES: ["relocat"],
    vocab.RELOCATION_NO: ["relocation"],
    vocab.URGENT: ["urgent", "immediate", "start asap", "asap", "hiring now", "openings",
                   "filling quickly"],
    vocab.AGENCY: ["staffing", "recruit", "talent ", "our client", "search firm", "headhunt"],
    vocab.EMAIL: ["@"],
    _HINTS["hourly"]: ["hour", "hr", "p/h"],
    _HINTS["weekly"]: ["week"],
    _HINTS["monthly"]: ["month", "per mo"],
    _HINTS["yearly"]: ["year", "annual", "annum", "yr"],
    vocab.PREFERRED_HEADING: ["preferred", "nice to have", "bonus", "plus", "desirable",
                              "advantageous"],
    vocab.REQUIRED_HEADING: ["require", "must have", "qualifications", "need", "essential"],
    vocab.YEARS_RANGE: ["year", "yr"],
    vocab.YEARS_SINGLE: ["year", "yr"],
}


def holds(low: Column, words: list[str]) -> Column:
    """Whether a lower-cased text holds one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def may_match(low: Column, pattern: str) -> Column:
    """False only if ``pattern`` occurs nowhere in a text whose lower case is ``low``."""
    return holds(low, CLUES[pattern]) if pattern in CLUES else F.lit(True)


def rlike(text: Column, pattern: str, low: Column | None = None) -> Column:
    """``text.rlike(pattern)``; ``low`` is the lower-cased text if that is another."""
    return may_match(text if low is None else low, pattern) & text.rlike(pattern)

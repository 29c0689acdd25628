"""Quality rules as a short-circuit cascade.

Every rule rejects on its own, so a document's verdict does not depend on their
order; the work does. Cost and selectivity of each rule are measured on a small
sample, and the rules are asked in descending rejections per second. A row stops at
its first rejecting rule, as conditions of one CASE are evaluated one by one.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A null or empty text has no
words and is rejected. Keys may be null or repeated; columns pass through.
"""

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.binding import let
from rolemill.llm.tables import keep, words

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Words of a text up to which a window's hash and place share one 64-bit number.
PACKED_WORDS = 1 << 20
SAMPLE_ROWS = 2000


def _repeats_by_number(w: Column, n: Column) -> Column:
    """Places of repeated 3-word windows; hash and place packed in a long."""
    low = F.lit(PACKED_WORDS - 1)
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        w[i], w[i + 1], w[i + 2]).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i))
    place = lambda x: x.bitwiseAND(low).cast("int")
    near = lambda a, b: (F.shiftright(a, 20) == F.shiftright(b, 20)) & _same(
        w, place(a), place(b))
    return let(F.sort_array(packed), lambda s: F.transform(F.filter(
        s, lambda x, k: ((k > 0) & near(x, s[k - 1])) | (
            (k < n - 3) & near(x, s[k + 1]))), place))


def _same(w: Column, i: Column, j: Column) -> Column:
    return (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2])


def _repeats_by_text(w: Column, n: Column) -> Column:
    """The same for longer texts: the windows' own words are sorted."""
    rows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i")))
    near = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    return let(F.array_sort(rows), lambda s: F.transform(F.filter(
        s, lambda x, k: ((k > 0) & near(x, s[k - 1])) | (
            (k < n - 3) & near(x, s[k + 1]))), lambda x: x["i"]))


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""
    def covered(places: Column) -> Column:
        return let(F.sort_array(places), lambda p: F.aggregate(
            p, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("sum")),
            lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.least(
                F.lit(3), x - acc["last"])).alias("sum")))["sum"])

    def count(w: Column) -> Column:
        n = F.size(w)
        return (F.when(n < 4, F.lit(0).cast("bigint"))
                .when(n <= PACKED_WORDS, covered(_repeats_by_number(w, n)))
                .otherwise(covered(_repeats_by_text(w, n))))

    return let(w, count)


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counters the rules read."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = F.length(F.translate(t, SPACES, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return docs.withColumns({
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": without.cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast("long"),
        "n_repeat_words": repeat_words(words(text)),
    })


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def rules(text: str = "text") -> list[Rule]:
    """The rules over ``base`` columns and the text."""
    n = F.col("n_words")
    t = F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]+", ""))
    upper = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return [
        Rule("few_words", n < 50),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 50 * n),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n)),
        Rule("repeated_lines", (F.col("n_dup_lines") > 3) & (
            2 * F.col("n_dup_lines") > F.size(F.split(t, "\n")))),
        Rule("capitals", 2 * upper > letters),
    ]


def measure(sample: DataFrame, given: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) of each rule alone on a kept sample."""
    out = []
    for rule in given:
        start = time.perf_counter()
        n, rejected = sample.agg(
            F.count(F.lit(1)), F.count_if(rule.rejects)).first()
        out.append((rule, time.perf_counter() - start, rejected / max(n, 1)))
    return out


def ordered(docs: DataFrame, given: list[Rule], text: str = "text",
            rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second, measured on about ``rows`` rows of
    ``docs``. The sample steers the order alone; it changes no verdict."""
    total = docs.count()
    sample = keep(base(docs.sample(min(1.0, rows / max(total, 1)), seed=7), text))
    measured = measure(sample, given)
    return [r for r, _, _ in sorted(
        measured, key=lambda m: -m[2] / max(m[1], 1e-6))]


def cascade(docs: DataFrame, order: list[Rule], name: str = "rejected_by") -> DataFrame:
    """``docs`` with the first rule that rejects each row, null for kept ones."""
    first = F.lit(None).cast("string")
    for rule in reversed(order):
        first = F.when(F.coalesce(rule.rejects, F.lit(False)), rule.name).otherwise(first)
    return docs.withColumn(name, first)

"""Format-preserving pseudonyms of personal data by a keyed Feistel network.

What a pattern finds is validated first: octets of addresses, Luhn sums of cards,
mod-97 sums of account numbers, calendar dates, area and group of social security
numbers. A valid value becomes a list of small numbers, each with its own range
(digits, letters, octets, a day number in two parts), which a Feistel network
permutes under the key; check digits are computed anew. So the pseudonym has the same
format and validates too, the mapping is one to one within a format, and equal
values have equal pseudonyms in all documents. E-mail addresses and secrets are
permuted letter by letter and digit by digit; ``@``, dots and separators stay.

What fails validation stays as it is, but a stretch of groups that is no valid card or
account number as a whole is searched for those that are: each begins and ends at a
separator or at the stretch's ends, the longest first. What they leave is searched for
cards, secrets, dates, social security and phone numbers. Whole texts are searched; null and empty texts
stay; other columns and repeated rows pass through.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.binding import let

KEY = "change me"
ROUNDS = 6
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IBAN = (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2}[0-9A-Z ]*(?<=[0-9A-Z])")
_CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12}[0-9 -]*(?<=[0-9])"
_OPEN = r"(?![0-9A-Za-z]|[-._%+@/:][0-9A-Za-z])"
# In the order in which they are tried at a place.
KINDS = {
    # The group's quantifier is possessive: Java repeats it in a loop, without recursion,
    # so a chain of any number of labels does not exhaust the stack.
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}"
              r"|sk-[0-9A-Za-z]{20,48})(?![0-9A-Za-z])",
    # Stretches of any length; the first ends before what may begin another value.
    "iban": rf"{_IBAN}{_OPEN}|{_IBAN}(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date_iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])",
    "date_dmy": r"(?<![0-9./])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": rf"{_CARD}{_OPEN}|{_CARD}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])"
             r"[0-9]{3}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
WHOLE = {k: f"^(?:{p})$" for k, p in KINDS.items()}
_IN_CARDS = "|".join(f"(?:{KINDS[k]})" for k in ("secret", "date_iso", "ssn", "phone"))
_ACCOUNT = r"^[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?$"
# A text without these has nothing to find; the test is cheap.
_HINT = "@|[0-9][0-9 ./()-]{6,}|[0-9a-zA-Z_-]{20}"


def _number(hexed: Column) -> Column:
    return F.conv(hexed, 16, 10).cast("long")


def feistel(values: Column, ranges: Column, tweak: Column, key: str,
            rounds: int = ROUNDS) -> Column:
    """``values`` permuted within the product of 0..range-1; both arrays of two or
    more. ``rounds`` is even."""
    half = F.floor(F.size(values) / 2).cast("int")

    def shifted(v: Column, r: Column, other: Column, step: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), tweak, step.cast("string"),
                           F.array_join(other.cast("array<string>"), ","))
        return let(seed, lambda s: F.transform(v, lambda x, i: F.pmod(
            x + _number(F.substring(F.sha2(F.concat_ws("|", s, i.cast("string")), 256), 1, 12)),
            r[i])))

    start = F.struct(
        F.slice(values, 1, half).alias("a"), F.slice(ranges, 1, half).alias("ra"),
        F.slice(values, half + 1, F.size(values) - half).alias("b"),
        F.slice(ranges, half + 1, F.size(ranges) - half).alias("rb"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, k: F.struct(
        s["b"].alias("a"), s["rb"].alias("ra"),
        shifted(s["a"], s["ra"], s["b"], k).alias("b"), s["ra"].alias("rb")))
    return let(end, lambda s: F.concat(s["a"], s["b"]))


def _long(c: Column) -> Column:
    return c.cast("long")


def _symbols(text: Column, tweak: str, key: str, hexed: bool = False) -> Column:
    """Digits and letters permuted within their class, other characters kept."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    first = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)
    letters = F.when(text.rlike("^[0-9A-Fa-f]+$"), 6).otherwise(26) if hexed else F.lit(26)
    span = lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(letters)

    def put(c: Column) -> Column:
        moving = F.filter(c, lambda x: x.rlike("[0-9A-Za-z]"))
        new = let(moving, lambda m: let(feistel(
            F.transform(m, lambda x: _long(F.ascii(x) - first(x))),
            F.transform(m, lambda x: _long(span(x))),
            F.concat_ws(":", F.lit(tweak), F.array_join(F.transform(
                m, lambda x: first(x).cast("string")), "")), key),
            lambda v: F.transform(v, lambda x, i: F.char(x + first(m[i])))))
        # Each character takes the next permuted one if it is of the moving kind.
        return let(new, lambda n: F.aggregate(c, F.struct(
            F.lit(0).alias("i"), F.lit("").alias("s")), lambda acc, x: F.struct(
                F.when(x.rlike("[0-9A-Za-z]"), acc["i"] + 1).otherwise(acc["i"]).alias("i"),
                F.concat(acc["s"], F.when(x.rlike("[0-9A-Za-z]"), n[acc["i"]])
                         .otherwise(x)).alias("s")))["s"])

    return let(chars, put)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits, mod 10; 0 for a valid number."""
    return F.pmod(F.aggregate(
        F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
                    lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 0, d).otherwise(
                        2 * d - F.when(d > 4, 9).otherwise(0)))),
        F.lit(0), lambda a, x: a + x), F.lit(10))


def _filled(pattern: Column, digits: Column) -> Column:
    """The digits put in place of the pattern's own, in order."""
    chars = F.filter(F.split(pattern, ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(1).alias("i"), F.lit("").alias("s")), lambda a, x: F.struct(
        F.when(x.rlike("[0-9]"), a["i"] + 1).otherwise(a["i"]).alias("i"),
        F.concat(a["s"], F.when(x.rlike("[0-9]"), F.substring(digits, a["i"], F.lit(1)))
                 .otherwise(x)).alias("s")))["s"]


def _is_card(m: Column) -> Column:
    return m.rlike("^[0-9](?:[ -]?[0-9]){12,18}$") & (_luhn(_digits(m)) == 0)


def _card(m: Column, key: str) -> Column:
    def put(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _symbols(
            F.substring(d, F.lit(2), F.length(d) - 2), "card", key))
        return let(body, lambda b: _filled(m, F.concat(b, F.pmod(
            10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))

    return F.when(_is_card(m), let(_digits(m), put)).otherwise(m)


def _mod97(account: Column) -> Column:
    """Account characters, country and check digits last, mod 97."""
    return F.aggregate(F.filter(F.split(account, ""), lambda c: c != ""), F.lit(0).cast("long"),
                       lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int"))
                       .otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _is_iban(m: Column) -> Column:
    moved = lambda t: F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))
    return m.rlike(_ACCOUNT) & (_mod97(moved(F.replace(m, F.lit(" "), F.lit("")))) == 1)


def _iban(m: Column, key: str) -> Column:
    solid = lambda t: F.replace(t, F.lit(" "), F.lit(""))

    def put(body: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(solid(body), F.substring(m, 1, 2), F.lit("00"))))
                       .cast("string"), 2, "0")
        return F.concat(F.substring(m, 1, 2), check, body)

    return F.when(_is_iban(m), let(_symbols(
        F.substring(m, F.lit(5), F.length(m)), "iban", key), put)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    ranges = F.array(*[F.lit(256).cast("long")] * 4)
    return F.array_join(feistel(octets, ranges, F.lit("ip"), key).cast("array<string>"), ".")


# 400 years repeat; their days are 189 * 773.
_DAY0, _HIGH, _LOW = "1800-01-01", 189, 773


def _date(m: Column, key: str, pattern: Column | str) -> Column:
    """A day of 1800 to 2199 in its own spelling; other days and no days stay."""
    day = F.try_to_date(m, pattern) if isinstance(pattern, str) else pattern
    n = F.datediff(day, F.lit(_DAY0).cast("date"))
    parts = F.array(_long(F.floor(n / _LOW)), _long(F.pmod(n, F.lit(_LOW))))
    ranges = F.array(F.lit(_HIGH).cast("long"), F.lit(_LOW).cast("long"))
    new = let(feistel(parts, ranges, F.lit("date"), key), lambda v: F.date_add(
        F.lit(_DAY0).cast("date"), (v[0] * _LOW + v[1]).cast("int")))
    return F.when((n >= 0) & (n < _HIGH * _LOW), F.date_format(new, pattern)).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, *s).cast("long") for s in ((1, 3), (5, 2), (8, 4)))
    valid = ~area.isin(0, 666) & (area < 900) & (group > 0) & (serial > 0)
    values = F.array(area - 1 - F.when(area > 666, 1).otherwise(0), group - 1, serial - 1)
    ranges = F.array(*[F.lit(r).cast("long") for r in (898, 99, 9999)])

    def put(v: Column) -> Column:
        a = v[0] + 1 + F.when(v[0] >= 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"),
                           F.lpad((v[1] + 1).cast("string"), 2, "0"),
                           F.lpad((v[2] + 1).cast("string"), 4, "0"))

    return F.when(valid, let(feistel(values, ranges, F.lit("ssn"), key), put)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _symbols(rest, "phone", key))


def _piece(text: Column, value: Column | bool) -> Column:
    return F.struct(text.alias("t"), F.lit(value).alias("v") if isinstance(value, bool)
                    else value.alias("v"))


def _valid_spans(m: Column, is_value, most: int) -> Column:
    """``m`` in pieces (t, v): from the left, the longest spans of groups that are valid
    values (v), of ``most`` groups at most, and what is between them."""
    def scan(g: Column) -> Column:
        span = lambda i, j: F.array_join(F.slice(g, i, j - i + 1), "")

        def step(a: Column, i: Column) -> Column:
            ends = F.reverse(F.sequence(i, F.least(F.size(g), i + 2 * most - 2)))
            good = F.filter(ends, lambda j: ~g[j - 1].rlike("[ -]") & is_value(span(i, j)))
            begins = (i > a["end"]) & ~g[i - 1].rlike("[ -]")
            end = F.when(begins, F.get(F.slice(good, 1, 1), F.lit(0)))
            return let(end, lambda e: F.when(e.isNull(), a).otherwise(F.struct(
                e.cast("int").alias("end"), F.concat(a["out"], F.array(
                    _piece(span(a["end"] + 1, i - 1), False),
                    _piece(span(i, e), True))).alias("out"))))

        start = F.struct(F.lit(0).alias("end"),
                         F.array().cast("array<struct<t:string,v:boolean>>").alias("out"))
        done = F.aggregate(F.sequence(F.lit(1), F.size(g)), start, step)
        return let(done, lambda d: F.concat(d["out"], F.array(
            _piece(span(d["end"] + 1, F.size(g)), False))))

    return F.when(is_value(m), F.array(_piece(m, True))).otherwise(
        let(F.regexp_extract_all(m, F.lit("[^ -]+|[ -]"), F.lit(0)), scan))


def _again(pieces: Column, pattern: str, cut) -> Column:
    """``pieces`` whose gaps are searched for ``pattern``; ``cut`` gives a find's pieces."""
    def gap(t: Column) -> Column:
        finds = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return let(finds, lambda f: F.flatten(F.transform(F.split(t, pattern), lambda x, i: F.concat(
            F.array(_piece(x, False)), F.when(i < F.size(f), cut(F.get(f, i))).otherwise(
                F.array().cast("array<struct<t:string,v:boolean>>"))))))

    return F.flatten(F.transform(pieces, lambda p: F.when(p["v"], F.array(
        _piece(p["t"], p["v"]))).otherwise(gap(p["t"]))))


def values_in(m: Column) -> Column:
    """A found stretch as the values in it and what is between them, in order."""
    one = lambda x: F.array(_piece(x, True))
    cards = lambda x: _valid_spans(x, _is_card, 19)
    texts = lambda pieces: F.filter(F.transform(
        pieces, lambda p: p["t"]), lambda t: t != "")
    account = m.rlike(WHOLE["iban"]) & ~m.rlike(WHOLE["email"]) & ~m.rlike(WHOLE["secret"])
    card = m.rlike(WHOLE["card"]) & ~m.rlike(WHOLE["secret"])
    inner = lambda pieces: _again(pieces, _IN_CARDS, one)
    return (F.when(account & ~_is_iban(m), texts(inner(_again(
                _valid_spans(m, _is_iban, 9), KINDS["card"], cards))))
            .when(card & ~_is_card(m), texts(inner(cards(m))))
            .otherwise(F.array(m)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value; other texts stay."""
    whole = WHOLE
    dotted = F.substring(m, 3, 1) == "."
    return (F.when(m.rlike(whole["email"]), _symbols(m, "email", key))
            .when(m.rlike(whole["secret"]), _symbols(m, "secret", key, hexed=True))
            .when(m.rlike(whole["iban"]), _iban(m, key))
            .when(m.rlike(whole["ip"]), _ip(m, key))
            .when(m.rlike(whole["date_iso"]), _date(m, key, "yyyy-MM-dd"))
            .when(m.rlike(whole["date_dmy"]) & dotted, _date(m, key, "dd.MM.yyyy"))
            .when(m.rlike(whole["date_dmy"]), F.when(
                F.try_to_date(m, "MM/dd/yyyy").isNotNull(), _date(m, key, "MM/dd/yyyy"))
                .otherwise(_date(m, key, "dd/MM/yyyy")))
            .when(m.rlike(whole["ssn"]), _ssn(m, key))
            .when(m.rlike(whole["card"]), _card(m, key))
            .when(m.rlike(whole["phone"]), _phone(m, key))
            .otherwise(m))


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY,
                 found: str = "n_found") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the number of values found."""
    t = F.col(text)
    hits = F.when(t.rlike(_HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    made = docs.withColumn("_hits", hits)
    between = F.split(t, ANY)
    new = F.array_join(F.transform(between, lambda x, i: F.concat(
        x, F.coalesce(F.get(F.col("_new"), i), F.lit("")))), "")
    some = F.coalesce(F.size("_hits"), F.lit(0)) > 0
    made = made.withColumn("_values", F.when(some, F.transform("_hits", values_in)))
    made = made.withColumn("_new", F.when(some, F.transform("_values", lambda v: F.array_join(
        F.transform(v, lambda m: pseudonym(m, key)), ""))))
    # A stretch without a valid value counts as one, as other finds do.
    n = F.aggregate("_values", F.lit(0), lambda a, v: a + F.greatest(F.lit(1), F.size(
        F.filter(v, lambda m: m.rlike(f"^(?:{ANY})$")))))
    return made.select(*[F.when(some, new).otherwise(t).alias(c) if c == text else F.col(c)
                         for c in docs.columns if c != found],
                       F.when(some, n).otherwise(0).cast("long").alias(found))

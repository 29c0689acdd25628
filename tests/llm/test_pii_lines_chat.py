import datetime as dt
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rolemill.llm import chat, line_dedup, pii


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def shape(s):
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", s)))


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


VALUES = ["jo.doe7@mail3.example.org", "10.0.200.7", "255.1.0.9", "4539 1488 0343 6467",
          "4539148803436467", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000",
          "2024-02-29", "31.12.1999", "11/25/2003", "25/11/2003", "219-09-9999",
          "+1 (017) 555-7713", "+44 20 7946 0958", "04dbebab91ab85687d33eeaaf9ac699e"]
STAY = ["300.1.1.1", "1.2.3.4.5", "4539148803436468", "GB29 NWBK 6016 1331 9268 18",
        "2023-02-30", "666-12-1234", "000-12-1234", "version 3.1", "12345"]


def run(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r["text"] for r in pii.pseudonymise(docs, key="k").orderBy("doc_id").collect()]


def test_values_change_within_their_format_and_stay_linked(spark):
    out = run(spark, [f"see {v}, or." for v in VALUES] + ["; ".join(VALUES)])
    new = [t[4:-5] for t in out[:-1]]
    for old, now in zip(VALUES, new):
        assert old != now, old
        if "@" not in old and not re.fullmatch(r"[\d.]+", old):
            assert shape(old) == shape(now)
    assert out[-1] == "; ".join(new)
    assert all(0 <= int(x) <= 255 for v in new[1:3] for x in v.split("."))
    assert luhn(new[3]) and luhn(new[4]) and new[3].replace(" ", "") == new[4]
    assert mod97(new[5]) == 1 and mod97(new[6]) == 1
    dt.date.fromisoformat(new[7])
    dt.datetime.strptime(new[8], "%d.%m.%Y")
    assert not set(STAY) & {x for x, y in zip(STAY, run(spark, STAY)) if x != y}


def test_valid_values_next_to_digits_and_capitals(spark):
    card, amount = "4111 1111 1111 1111", "AT611904300234573201"
    texts = [f"{card} 12/25", "4111111111111111 123", "2 4539148803436467", f"{amount} EUR",
             "AT61 1904 3002 3457 3201 2024-02-29", f"XY12 ABCD EFGH {amount} {card}",
             f"{card} 4539 1488 0343 6467 219-09-9999", "4111111111111111 31.12.1999",
             "123 456 7890 123 456 7891", f"{card} " * 300, "TOKEN=9233A8EC01F5B7D69233A8EC01F5B7D6"]
    for old, new in zip(texts, run(spark, texts)):
        assert shape(old) == shape(new) and old != new
    out = run(spark, texts)
    alone = run(spark, [card, "4539 1488 0343 6467", "219-09-9999", amount, "2024-02-29", "31.12.1999"])
    assert out[0] == f"{alone[0]} 12/25"
    assert out[1] == f"{alone[0].replace(' ', '')} 123"
    assert out[2] == f"2 {alone[1].replace(' ', '')}"
    assert out[3] == f"{alone[3]} EUR"
    assert out[4].replace(" ", "") == alone[3] + alone[4]
    assert out[5] == f"XY12 ABCD EFGH {alone[3]} {alone[0]}"
    assert out[6] == " ".join(alone[:3])
    assert out[7] == f"{alone[0].replace(' ', '')} {alone[5]}"
    assert out[8][:12] != texts[8][:12] and out[8][13:] != texts[8][13:]
    assert out[9] == f"{alone[0]} " * 300


def test_permutation_is_one_to_one(spark):
    ips = [f"10.{i // 256}.{i % 256}.1" for i in range(1500)]
    assert len(set(run(spark, ips))) == len(ips)
    days = [str(dt.date(2000, 1, 1) + dt.timedelta(i)) for i in range(1500)]
    new = run(spark, days)
    assert len(set(new)) == len(days) and all(dt.date.fromisoformat(d) for d in new)


def test_odd_texts(spark):
    texts = [None, "", " ", "x" * 100_000 + " 10.0.0.1", "10.0.0.1", "10.0.0.1"]
    out = run(spark, texts)
    assert out[:3] == texts[:3] and out[4] == out[5] and len(out[3]) > 100_000
    docs = spark.createDataFrame([(1, "a 10.0.0.1", "n")], "doc_id int, text string, n_found string")
    assert pii.pseudonymise(docs).columns == ["doc_id", "text", "n_found"]
    assert pii.pseudonymise(docs.limit(0)).count() == 0


def test_long_chains_of_every_kind_end(spark):
    units = ["a.", "a@", "1 ", "1-", "AA11 ", "1.", "(12) ", "+1 ", "A", "é", "-", "0a", "_%"]
    texts = ["x@" + unit * (8_000 // len(unit)) for unit in units]
    out = run(spark, [f"mail ann@example.org {t}" for t in texts])
    assert all(len(o) == len(t) + 21 and "ann@example.org" not in o for o, t in zip(out, texts))
    docs = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)],
                                 "doc_id int, source string, text string")
    assert line_dedup.dedup_lines(docs).count() == len(texts)


def expected_lines(rows, sites):
    where, first = defaultdict(set), {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, site, text in order:
        for p, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\x0b\x0c\r")
            if len(line.split()) >= 3:
                where[line].add(site)
                first.setdefault(line, (i, p))
    out = {}
    for i, site, text in order:
        if text is None:
            out[i] = None
            continue
        kept = []
        for p, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\x0b\x0c\r")
            gone = (len(line.split()) >= 3 and len(where[line] - {None}) >= sites
                    and first[line] != (i, p))
            kept += [] if gone else [raw]
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("sites", [2, 3, 12])
def test_lines_equal_brute_force(spark, sites):
    rows = [(i, f"s{i % 15}", f"own {i} text here\n  the shared footer line \n"
             + f"group {i // (i % 13 + 1)} has lines\n" + "a b") for i in range(120)]
    rows += [(500, None, "the shared footer line\nthe shared footer line"), (501, "s1", ""),
             (502, "s2", None), (None, "s3", "the shared footer line\nnull key row is")]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumn(
        "_pos", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, sites=sites).collect()}
    assert got == expected_lines(rows, sites)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo é"),
            (1, 70, "ann", "bye"), (2, 0, "system", "alone"), (3, 5, None, None),
            (None, 1, "eve", "x"), (1, 1, "ann", "hi")]
    out = chat.rotate(spark.createDataFrame(
        rows, "conv_id int, turn int, role string, text string")).collect()
    seen = {(r["conv_id"], r["speaker"], r["part"]): r for r in out}
    assert set(seen) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1),
                         (3, "unknown", 0), (None, "eve", 0)}
    ann = seen[1, "ann", 0]
    assert ann["text"] == ("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n"
                           "<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo é<|end|>\n")
    assert [ann["text"][a:b] for a, b in ann["masks"]] == ["hi<|end|>"] * 2
    bob = seen[1, "bob", 0]
    assert [bob["text"][a:b] for a, b in bob["masks"]] == ["yo é<|end|>"]
    assert seen[1, "ann", 1]["start"] == len(ann["text"])
    assert seen[1, "bob", 1]["masks"] == []

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolemill.llm import quality, sharding

SPACE = set(" \t\n\x0b\x0c\r")


def split(text):
    word, out = "", []
    for c in text + " ":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def counters(text):
    text = text or ""
    w = split(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3)
               if grams[tuple(w[i:i + 3])] > 1}
    lines = [x for x in text.split("\n") if split(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "x x x x x x",
         "é ü #1\n\nsame line\nsame line\r\n same line", "a b c d " * 40,
         "\n".join(f"word{i} word{i+1} is here" for i in range(60)),
         "#$% & || <b>" * 30, "HELLO THERE " * 5 + " ".join(f"W{i}" for i in range(60)),
         "z" * 5000, "한글 \U0001f600 \U0001f600 \U0001f600 \U0001f600"]


@pytest.mark.parametrize("packed", [True, False])
def test_counters_equal_brute_force(spark, monkeypatch, packed):
    if not packed:
        monkeypatch.setattr(quality, "PACKED_WORDS", 8)
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, "a")], "doc_id int, text string")
    for r in quality.base(docs.withColumn("x", F.lit(1))).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
               r["n_repeat_words"])
        assert got == counters(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]


def test_cascade_verdict_is_free_of_order(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rules = quality.rules()
    kept = [{(r[0], r[1]) for r in quality.cascade(quality.base(docs), order).select(
        "doc_id", F.col("rejected_by").isNull()).collect()} for order in (
            rules, rules[::-1], quality.ordered(docs, rules))]
    assert kept[0] == kept[1] == kept[2]
    assert quality.ordered(docs.limit(0), rules)
    plan = quality.cascade(quality.base(docs), rules)
    assert {r["rejected_by"] for r in plan.collect() if not r["text"]} == {"few_words"}


def test_order_follows_rejection_per_cost():
    from unittest import mock
    a, b, c = (quality.Rule(x, None) for x in "abc")
    with mock.patch.object(quality, "measure", return_value=[(a, 1, .5), (b, .1, .2), (c, 1, 0)]), \
            mock.patch.object(quality, "keep"), mock.patch.object(quality, "base"):
        docs = mock.Mock(count=lambda: 9)
        assert [r.name for r in quality.ordered(docs, [a, b, c])] == ["b", "a", "c"]


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_shards_are_even_and_groups_together(spark, n):
    texts = [f"text {i % 160}" if i % 3 else f"own {i}" for i in range(n)]
    texts = [None if i % 50 == 0 else "hot" if i % 5 == 0 else t for i, t in enumerate(texts)]
    rows = [(i % 490, t, "x") for i, t in enumerate(texts)]
    out = sharding.shard(spark.createDataFrame(
        rows, "doc_id int, text string, shard string"), shards=8).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter(
        (i, len((t or "").encode()) + 16) for i, t, _ in rows)
    assert all(0 <= r["shard"] < 8 for r in out)
    by = Counter(r["shard"] for r in out)
    assert max(by.values(), default=0) - min((by[s] for s in range(8)), default=0) <= 1
    for s in by:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(by[s]))
    if n == 500:
        small = {zlib.crc32(t.encode()) for t, c in Counter(texts).items()
                 if t and 1 < c < 10}
        where = {}
        for r in out:
            if r["text_crc32"] in small:
                where.setdefault(r["text_crc32"], set()).add(r["shard"])
        assert sum(len(x) > 1 for x in where.values()) <= len(where) // 4

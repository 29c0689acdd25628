import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolemill.llm import bpe, packing

TEXTS = ["", None, " \n\t ", "Plain words, twice: plain words.", "it's we'LL don't ''s !'s",
         "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "Ünïcödé é  x y ŒUVRE",
         "antidisestablishment" * 200, "\U0001f600" * 300, "0123456789" * 90,
         "the cat " * 400, "a" * 3000, "日本語のテキスト" * 100, "<" * 90 + " a<b"]


@pytest.fixture(scope="module")
def whole():
    tok = bpe.tokenizer(None)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_encode_equals_library_and_decode(spark, whole):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "null key"),
                                                    (7, TEXTS[7])]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    out = bpe.decode(bpe.encode(docs.withColumn("_x", F.lit(1)), unit=64)).collect()
    assert len(out) == len(rows)
    text = dict(rows)
    tok = bpe.tokenizer(None)
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == whole(text[r["doc_id"]])
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False)
        assert hashlib.sha256(r["ids"]).hexdigest() == bpe.ids_sha256(np.array(ids))
    assert bpe.encode(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("ab'stel!. é́ñ9<|>", max_size=120), st.integers(0, 120))
def test_join_anywhere_equals_whole(text, cut):
    tok = bpe.tokenizer(None)
    sides = []
    for part in (text[:cut], text[cut:]):
        made = bpe._spans(tok.encode(part, add_special_tokens=False))
        sides.append((part, *made))
    _, ids, _ = bpe.join_encoded(tok, *sides, window=2)
    assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_assign_fills_every_bin(lengths):
    pieces = packing.assign(np.array(lengths, np.int64), 64)
    held = {}
    for _, _, n, b in pieces:
        held[b] = held.get(b, 0) + n
    assert sum(held.values()) == sum(lengths)
    assert all(held[b] == 64 for b in range(len(held) - 1))
    for item, n in enumerate(lengths):
        spans = sorted((a, a + k) for i, a, k, _ in pieces if i == item)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_packing_is_a_partition_of_all_ids(spark, whole):
    rows = [(i, (t or "") * 3 if t else t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, "y")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    out = packing.pack(docs, capacity=256, block_tokens=900).toPandas()
    expected = {}
    for k, t in rows:
        expected.setdefault(k, []).append(np.array(whole(t) + [1], "<u4"))
    assert out["length"].sum() == sum(len(x) for v in expected.values() for x in v)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum()[:-1]])).all()
        assert g["length"].sum() == g["sequence_length"].iloc[0] <= 256
        assert int(g["length"].sum()).bit_count() == 1
    for key in (1, 6, 7, 10):
        ids = expected[key][0]
        g = out[out["doc_id"] == key].sort_values("start")
        assert g["length"].sum() == len(ids) == g["doc_tokens"].iloc[0]
        for start, n, crc in g[["start", "length", "ids_crc32"]].itertuples(index=False):
            assert zlib.crc32(ids[start:start + n].tobytes()) == crc
    assert packing.pack(docs.limit(0)).count() == 0


def test_cost_is_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 700, 4000)
    cost = {}
    for _, _, n, b in packing.assign(lengths):
        cost[b] = cost.get(b, 0) + n + n * n / 2048
    costs = np.array(list(cost.values()))
    first_fit = np.full(len(costs) * 2, 2048)
    plain = np.zeros(len(first_fit))
    for n in -np.sort(-lengths):
        b = int(np.argmax(first_fit >= n))
        first_fit[b] -= n
        plain[b] += n + n * n / 2048
    assert costs.std() <= plain[plain > 0].std()

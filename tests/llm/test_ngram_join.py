import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolemill.llm import components, ngram_join, shingles


def sets_of(text, words):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1)))


def brute(rows, words, num, den):
    own = {i: sets_of(t, words) for i, t in rows}
    parent = {i: i for i in own}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(own)
    for x in range(len(ids)):
        for y in range(x):
            a, b = own[ids[x]], own[ids[y]]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = sorted((root(ids[x]), root(ids[y])))
                parent[q] = p
    return {i: (len(own[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    footer, rows = text(40), []
    for _ in range(14):
        base = text(rng.choice([3, 8, 20, 60, 150]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < .4:
                t += footer
            rows.append(" ".join(t))
    rows += ["", None, " \n", "One", "one", "a b c", "A b c", " ".join(footer)]
    chain = text(120)
    for _ in range(12):
        rows.append(" ".join(chain))
        chain = chain[5:] + text(5)
    rng.shuffle(rows)
    return [(i + 10, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words,num,frequent", [(4, 85, 3), (5, 80, 16)])
def test_components_equal_brute_force(spark, monkeypatch, words, num, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    rows = corpus(words)
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("n", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in ngram_join.link(docs, words=words, num=num).collect()}
    assert got == brute(rows, words, num, 100)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    out = ngram_join.link(docs).collect()
    assert len(out) == 5
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(1, 1), (None, None), (2, 2), (3, 3)}
    assert ngram_join.link(docs.limit(0)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for trial in range(400):
        n = int(rng.integers(2, 300))
        x = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        drop = ngram_join.errors(len(x), 85, 100)
        y = x[np.sort(rng.permutation(len(x))[:len(x) - int(rng.integers(0, drop + 1))])]
        pool = np.unique(np.concatenate([x, y]))
        frequent = np.sort(pool[rng.random(len(pool)) < rng.choice([0, .5, .9, 1])])
        if 100 * len(y) < 85 * len(x) or not len(y):
            continue
        a, b = (set(ngram_join.signatures(s, len(s), frequent, 85, 100).tolist()) for s in (x, y))
        assert a & b


@pytest.mark.parametrize("num", [80, 85])
def test_sets_with_tokens_of_their_own_share_a_signature(num):
    rng = np.random.default_rng(num)
    linked = 0
    for trial in range(1500):
        n = int(rng.integers(2, 300))
        pool = np.unique(rng.integers(0, 1 << 40, 2 * n).astype(np.uint64))
        rng.shuffle(pool)
        lost, own = (int(rng.integers(0, n // 6 + 1)) for _ in range(2))
        if n == lost or 100 * (n - lost) < num * (n + own):
            continue
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:n - lost], pool[n:n + own]]))
        frequent = np.sort(pool[rng.random(len(pool)) < rng.choice([0, .5, .9, 1])])
        a, b = (set(ngram_join.signatures(s, len(s), frequent, num, 100).tolist()) for s in (x, y))
        assert a & b
        linked += 1
    assert linked > 300


def test_combinations_of_one_set_do_not_depend_on_its_slice():
    tokens = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 90).astype(np.uint64))
    made, begin = ngram_join.combinations(tokens, np.array([0, 50, 50, 90]), 85, 100)
    alone = ngram_join.combinations(tokens[50:], np.array([0, 40]), 85, 100)[0]
    assert begin[1] == begin[2] and np.array_equal(made[begin[2]:], alone)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_shingles_do_not_cross_texts():
    import pyarrow as pa
    texts = ["A b", "c", None, "", "é à ü", "a\x0bb\tc d"]
    for _, raw, offsets in shingles.text_slices(pa.array(texts)):
        _, begin = shingles.shingle_sets(raw, offsets, 2)
        assert np.diff(begin).tolist() == [1, 1, 0, 0, 2, 3]

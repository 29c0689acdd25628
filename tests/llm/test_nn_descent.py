import numpy as np

from rolemill.llm import nn_descent


def test_recall_order_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 12))
    v = centres[rng.integers(0, 12, 600)] + .4 * rng.standard_normal((600, 12))
    v[7] = v[20]  # equal vectors tie
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v)]
    nan = float("nan")
    rows += [(1000, None, "x"), (1020, [0.0] * 12, "x"), (1040, [nan] * 12, "x"),
             (1060, [None] + [1.0] * 11, "x"), (None, [1.0] * 12, "x")]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>, score string")
    got = {}
    for r in nn_descent.neighbours(table, top=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        s = v @ v[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(600), -s))[:10].tolist())
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert all(abs(s[i] - x) < 1e-9 for _, i, x in found)
        assert [(-x, i) for _, i, x in found] == sorted((-x, i) for _, i, x in found)
        hits += len(best & {i for _, i, _ in found})
    assert hits >= .9 * 10 * len(got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nn_descent.neighbours(empty).count() == 0


def _packed(spark, v):
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return nn_descent.nodes_of(nn_descent.valid(table, "vec_id", "embedding"))[0]


def test_hot_code_is_cut_by_other_planes_in_each_table(spark, monkeypatch):
    """The starting blocks alone must bring most true neighbours of a tight cluster
    together; cut at random and alike in all tables they did not."""
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((2000, 8))
    v[:1200] = 3 + .3 * rng.standard_normal((1200, 8))
    found = {}
    for r in nn_descent.build(_packed(spark, v), degree=10, rounds=0).collect():
        found.setdefault(r.u, set()).add(r.x)
    hits = 0
    whole = np.concatenate([v, np.sqrt(np.maximum(
        0, (v ** 2).sum(1).max() - (v ** 2).sum(1)))[:, None]], 1)
    for q in range(0, 1200, 20):
        s = whole @ whole[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:10].tolist()) & found[q])
    assert hits >= .8 * 10 * 60  # 151 of 600 before


def test_equal_bytes_still_divide(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    v = np.ones((300, 4)) + np.arange(300)[:, None] * 1e-9
    rows = nn_descent.build(_packed(spark, v), degree=4).collect()
    assert {r.u for r in rows} == set(range(300))


def test_other_lengths_have_neighbours_of_their_own(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(60)]
    rows += [(i, [float(x) for x in rng.standard_normal(3)]) for i in range(60, 90)]
    rows += [(100, [1.0] * 40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.neighbours(table, top=5).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 20, 40, 60, 80}
    for q, found in got.items():
        v = dict(rows)
        same = [i for i in v if len(v[i]) == len(v[q]) and i != q]
        assert sorted(found) == sorted(sorted(
            same, key=lambda i: -np.dot(v[i], v[q]))[:5])

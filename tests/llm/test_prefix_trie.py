import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rolemill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string"


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    new = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        new[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        gain = (len(convs) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += not children[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(new[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256").collect()), key=str)


def talks(seed, n=260):
    rng, rows = random.Random(seed), []
    for c in range(n):
        c = c if c < n - 40 else c * 7 + 1000
        for turn in range(rng.choice([1, 2, 3, 8])):
            rows.append((c, turn, rng.choice(["user", "assistant"]),
                         rng.choice(["hi", "what?", "é 💡", "a" * 30]), "x"))
    for c in range(3000, 3090):  # copies of one conversation, and one first turn for many
        rows += [(c, t, "user", f"copy {t}", "x") for t in range(3)]
        rows += [(c + 1000, 0, "user", "copy 0", "x"), (c + 1000, 1, "user", f"own {c}", "x")]
    rows += [(5000, None, None, "null first", "x"), (5000, 0, "user", None, "x"),
             (5000, 7, "user", "later", "x"), (5001, 3, "user", "same", "x"), (None, 1, "user", "x", "x")]
    rows += [(6001, t, "user", f"t{t % 3}", "x") for t in range(400)]
    rows += [(5001, 3, "user", "same", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows,rebuild", [(7, True), (3, False), (50_000, True)])
def test_nodes_equal_brute_force(spark, monkeypatch, block_rows, rebuild):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(prefix_trie, "IDS_CHARS", 60)
    rows = talks(block_rows)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = prefix_trie.rebuilt(turns) if rebuild else prefix_trie.whole(turns)
    assert found(prefix_trie.trie(made)) == brute(rows, rebuild)


def test_empty_and_turnless(spark):
    assert found(prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([], SCHEMA)))) == []
    # 105 keeps none of its own turns and has no head: a member of the root alone.
    c = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone", "x")]
    out = found(prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))))
    assert out == brute(rows) and len(out) == 1


def test_range_minimum_and_searches():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 4, 300)
    values[0] = -1
    table = prefix_trie.RangeMin(values)
    at, bound = rng.integers(0, 300, 500), rng.integers(0, 5, 500)
    for i, b, left, right in zip(at, bound, table.left(at, bound), table.right(at, bound)):
        assert right == next((k for k in range(i + 1, 300) if values[k] < b), 300) - 1
        assert left == next(k for k in range(i, -1, -1) if values[k] < b)
    ends = np.maximum(at, np.roll(at, 1))
    assert (table.minimum(at, ends) == [values[a:b + 1].min() for a, b in zip(at, ends)]).all()

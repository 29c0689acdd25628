import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rolemill.llm import token_align


def letters():
    """GPT-2 style: printable bytes stand for themselves, the others are counted from 256."""
    out, k = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(256 + k)] = b
            k += 1
    return out


def tokens(text):
    """A's and B's (id, bytes) of a text by the libraries."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    table = letters()

    def of(text):
        if not text:
            return [], []
        one = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in one.ids]
        right = []
        for i in b.encode(text, num_threads=1):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        own = (" " + text).encode()
        if b"".join(x for _, x in left) != own or b"".join(x for _, x in right) != own:
            return [], []
        return left, right

    return [of(t) for t in text]


def brute(rows):
    out, links_of, total = [], [], Counter()
    for (doc, _), (left, right) in zip(rows, tokens([t for _, t in rows])):
        a, b, links, at = [], [], [], 0
        for own, side in ((a, left), (b, right)):
            at = 0
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
        for i, s, e in a:
            links += [(i, j) for j, t, f in b if s < f and t < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = ";".join(
            ",".join(str(i) for i, _, e in a if low < e <= high) + "|"
            + ",".join(str(i) for i, _, e in b if low < e <= high)
            for low, high in zip([0, *cuts], cuts))
        total.update(links)
        links_of.append(links)
        out.append((doc, len(a), len(b), len(cuts), len(links),
                    hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (_, j), n in total.items():
        top[j] = max(top[j], n)
    return sorted(((*r[:5], sum(total[p] == top[p[1]] for p in links), sum(total[p] for p in links), r[5])
                   for r, links in zip(out, links_of)), key=str)


def texts():
    rng = random.Random(4)
    alphabet = list("abcdefgh THEandof.,!?'\n\t  ") + ["é", "ß", "💡", "日本", "▁", "\x00", "<s>", " the",
                                                       "<|endoftext|>", " ", " ", "é"]
    rows = [(None, "a null id"), (7, None), (8, ""), (9, " "), (10, "one"), (10, "one"), (11, "<unk></s>"),
            (12, "  two  spaces \n\n end "), (13, "x" * 900), (14, "日" * 300), (15, "💡" * 80 + " a b " * 60)]
    for i in range(150):
        use = alphabet if i % 3 else [c for c in alphabet if c != "▁"]
        rows.append((100 + i, "".join(rng.choice(use) for _ in range(rng.randint(1, 160)))))
    words = ["".join(rng.choice("abcdeéf日") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    rows.append((500, " ".join(rng.choice(words) for _ in range(700))))
    return rows


@pytest.mark.parametrize("unit,block,size", [(32_768, 1 << 19, 16 << 20), (50, 300, 900), (1, 1, 1)])
def test_equal_to_brute_force(spark, monkeypatch, unit, block, size):
    monkeypatch.setattr(token_align, "UNIT", unit)
    monkeypatch.setattr(token_align, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_align, "SLICE_BYTES", size)
    rows = texts()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_a string")
    out = token_align.align(docs.repartition(3))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align(docs).collect() == []
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, token_align.align(docs).collect())) == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_divide_finds_all_shared_ends():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.02, 0.3, 1.0):
        ends = np.arange(1, 4001)
        both = rng.random(4000) < share
        a = ends[both | (rng.random(4000) < .3) | (ends == 4000)]
        b = ends[both | (rng.random(4000) < .3) | (ends == 4000)]
        groups = token_align.divide(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
        assert a[groups[1] - 1].tolist() == np.intersect1d(a, b).tolist()
        assert (a[groups[1] - 1] == b[groups[3] - 1]).all()

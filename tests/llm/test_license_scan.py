import random
import re

import pytest

from rolemill.llm import license_scan, license_texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    """(n_words, places, first, last, labels) by looking at every place."""
    own, places, labels = words(text), [], set()
    for phrase, label in license_texts.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(own)) if own[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(own), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def longest_runs(own, sequences):
    """For each place, the length of the longest run up to it that occurs in a sequence."""
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    out = []
    for i in range(len(own)):
        run = 0
        while run <= i and tuple(own[i - run:i + 1]) in known:
            run += 1
        out.append(run)
    return out


def rows():
    rng, out = random.Random(8), []
    filler = ["the", "of", "license", "mit", "public", "general", "apache", "gnu", "werk", "é", "x1", "copy"]
    for i in range(200):
        parts = [rng.choice(filler) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(license_texts.TEMPLATES)[1])
        sep = rng.choice([" ", "\n", ", ", "-"])
        out.append((i, sep.join(parts).upper() if rng.random() < .3 else sep.join(parts)))
    return out + [(500, None), (501, ""), (502, " .,; "), (None, "MIT license"), (503, "MIT\x00LICENSE"),
                  (504, "mit license mit license"), (504, "mit license mit license"), (505, "mit licenses"),
                  (506, "general public licensé"), (507, "é" * 5000 + " MIT-License")]


@pytest.mark.parametrize("block", [2 << 20, 40])
def test_base_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(license_scan, "BLOCK_BYTES", block)
    data = rows()
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, labels string")
    out = [(r.doc_id, r.n_words, r.n_places, r.first_word, r.last_word, r.phrase_labels)
           for r in license_scan.scan(docs.repartition(3)).collect()]
    assert sorted(out, key=str) == sorted(((i, *base(t)) for i, t in data), key=str)


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(60):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(4)]
        automaton = license_scan.Automaton(sequences, 1)
        text = [rng.randrange(4) for _ in range(60)]
        state, run, got = 0, 0, []
        for i, token in enumerate(text):
            while state and token not in automaton.next[state]:
                state = automaton.link[state]
                run = automaton.length[state]
            if token in automaton.next[state]:
                state, run = automaton.next[state][token], run + 1
            else:
                run = 0
            got.append(run)
            if run:
                own = text[i - run + 1:i + 1]
                assert sorted(automaton.ends[state]) == sorted(
                    (k, j) for k, s in enumerate(sequences) for j in range(len(s))
                    if j + 1 >= run and s[j - run + 1:j + 1] == own)
                ended = list(automaton.whole[state])
                if run == automaton.length[state]:
                    ended += automaton.exact[state]
                assert sorted(ended) == [k for k, s in enumerate(sequences) if text[max(0, i - len(s) + 1):i + 1] == s
                                         and len(s) <= run]
        assert got == longest_runs(text, sequences)


def test_edited_licence_text_is_one_span(spark):
    label, text = license_texts.TEMPLATES[1]
    own = text.split()
    for at in (20, 70, 110):
        own[at] = "changed"
    own.insert(50, "a few words more")
    rng = random.Random(1)
    filler = " ".join(rng.choice(["lorem", "the", "of", "software"]) for _ in range(300))
    docs = spark.createDataFrame(
        [(1, f"{filler} {' '.join(own)} {filler}"), (2, filler), (3, " ".join(own[:60])),
         (4, f"{' '.join(own)}\n{filler}\n{' '.join(own)}")], "doc_id long, text string")
    out = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert out[1].labels == label and len(out[1].spans) == 1
    span = out[1].spans[0]
    assert (span.first_word, out[1].phrase_labels) == (300, "") and span.coverage > .95
    assert span.last_word == 300 + len(words(" ".join(own))) - 1
    assert (out[2].labels, out[3].labels) == ("", "") and out[2].score < .2 < out[3].score < .8
    assert [s.label for s in out[4].spans] == [label, label]


def test_notices_name_their_own_licence_only(spark):
    lines = [("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY 4.0.", "cc-by"),
             ("All rights reserved.", "proprietary"), ("Released under the MIT License.", "mit"),
             ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
             ("Licensed under the Apache License, Version 2.0.", "apache"), ("All rights", "")]
    docs = spark.createDataFrame([(i, f"Some words. {t}\nmore") for i, (t, _) in enumerate(lines)],
                                 "doc_id long, text string")
    out = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert out == {i: label for i, (_, label) in enumerate(lines)}


def test_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []

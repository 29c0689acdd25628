"""Licence texts in documents, by matching statistics on a generalised suffix automaton.

The automaton holds every sequence of words that occurs in a licence text; it is built
once a worker from the texts given (some two states a word). Documents stream through
it: after each word it knows the longest run of words up to there that occurs in a
licence text, and where. A run of at least ``MIN_WORDS`` that the next word does not
prolong is a match. Matches of one licence text that follow each other in the document
and in the licence text, with at most ``MAX_GAP`` words left out on either side, are
chained; a chain that covers ``MIN_COVERED`` of the licence text is a span and labels the
document. Phrases are licence texts of their own: each place where one ends a run, exactly
and as a whole, counts.

Words are those of the text with A-Z in lower case: runs of digits, letters a-z and
characters above U+007F. Words that stand in no pair of neighbours of a licence text
cannot prolong a run and are passed over by array operations. A long text is taken in
blocks of ``BLOCK_BYTES``, the automaton's state goes on from block to block.

A null or empty text has no words, labels '' and score 0. Every row gives one row, equal
rows too. Extra columns are not read.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm import license_texts, shingles
from rolemill.llm.tables import worker_memory

MIN_WORDS = 3
MAX_GAP = 12
MIN_COVERED = 0.8
BLOCK_BYTES = 2 << 20

_BETWEEN = np.zeros(256, bool)
_BETWEEN[:0x30] = _BETWEEN[0x3A:0x61] = _BETWEEN[0x7B:0x80] = True


def split_words(text: str) -> list[bytes]:
    raw = shingles.lowered(np.frombuffer(text.encode(), np.uint8))
    starts, ends = shingles.word_spans(raw, np.array([0, len(raw)]), _BETWEEN)
    return [raw[a:b].tobytes() for a, b in zip(starts, ends)]


class Automaton:
    """Generalised suffix automaton of sequences of tokens.

    ``ends[s]`` lists (sequence, place) of all ends of the state's runs, for states with
    runs of at least ``least`` tokens; ``whole[s]`` the sequences that end every run of
    the state, ``exact[s]`` those that are its longest run."""

    def __init__(self, sequences: list[list[int]], least: int):
        self.next, self.link, self.length = [{}], [-1], [0]
        own, last_of = defaultdict(list), []
        for k, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                own[last].append((k, place))
            last_of.append(last)
        self.ends, self.exact, self.whole = own, defaultdict(list), defaultdict(tuple)
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for k, state in enumerate(last_of):
            if state:
                self.exact[state].append(k)
        for state in reversed(by_length):
            if self.length[self.link[state]] >= least:
                own[self.link[state]] += own[state]
        for state in by_length:
            up = self.link[state]
            self.whole[state] = (*self.whole[up], *self.exact[up])

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            found = self.next[last][token]
            if self.length[found] == self.length[last] + 1:
                return found
            return self._clone(found, last, token)
        made = self._state({}, 0, self.length[last] + 1)
        at = last
        while at != -1 and token not in self.next[at]:
            self.next[at][token] = made
            at = self.link[at]
        if at != -1:
            found = self.next[at][token]
            fits = self.length[found] == self.length[at] + 1
            self.link[made] = found if fits else self._clone(found, at, token)
        return made

    def _clone(self, found: int, at: int, token: int) -> int:
        """The part of state ``found`` with runs no longer than those of ``at`` + token."""
        made = self._state(dict(self.next[found]), self.link[found], self.length[at] + 1)
        self.link[found] = made
        while at != -1 and self.next[at].get(token) == found:
            self.next[at][token] = made
            at = self.link[at]
        return made

    def _state(self, after: dict, link: int, length: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1


class Licences:
    """The automaton of phrases and licence texts, and the filter on pairs of words."""

    def __init__(self, phrases: dict, templates: list):
        words = [split_words(p) for p in phrases] + [split_words(t) for _, t in templates]
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.n_phrases, self.sizes = len(phrases), [len(w) for w in words]
        self.ids = {w: k for k, w in enumerate(sorted({w for own in words for w in own}))}
        sequences = [[self.ids[w] for w in own] for own in words]
        self.automaton = Automaton(sequences, MIN_WORDS)
        spelled = list(self.ids)
        raw = np.frombuffer(b"".join(spelled), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in spelled])]).astype(np.int64)
        hashes = shingles.hash_words(raw, bounds[:-1], bounds[1:])
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], order
        size = len(spelled)
        self.pairs = np.zeros((size, size), bool)
        for own in sequences:
            self.pairs[own[:-1], own[1:]] = True

    def candidates(self, hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Places of words that can belong to a run of two or more; of words at the edge
        of a block, whose neighbour is not known, all that occur in licence texts."""
        if not len(hashes) or not len(self.hashes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = np.flatnonzero(self.hashes[at] == hashes)
        ids = self.of_hash[at[known]]
        near = (known[1:] == known[:-1] + 1) & self.pairs[ids[:-1], ids[1:]]
        use = edge[known]
        use[1:] |= near
        use[:-1] |= near
        return known[use]


class Scan:
    """What is known of a document while its words pass by."""

    def __init__(self, licences: Licences):
        self.licences, self.state, self.run, self.at = licences, 0, 0, -2
        self.n_words, self.places, self.first, self.last = 0, 0, None, None
        self.phrase_labels, self.best, self.spans = set(), 0.0, []
        self.recent = defaultdict(list)

    def word(self, at: int, token: int) -> None:
        """The next candidate word, the document's ``at``-th."""
        automaton = self.licences.automaton
        after, state = automaton.next, self.state
        if at != self.at + 1:
            self._match()
            state, self.run = 0, 0
        elif token not in after[state]:
            self._match()
            while state and token not in after[state]:
                state = automaton.link[state]
            self.run = automaton.length[state]
        self.at = at
        if token in after[state]:
            state = after[state][token]
            self.run += 1
        self.state = state
        ended = automaton.whole[state]
        if self.run == automaton.length[state] and state in automaton.exact:
            ended = (*ended, *automaton.exact[state])
        for k in ended:
            if k < self.licences.n_phrases:
                start = at - self.licences.sizes[k] + 1
                self.places += 1
                self.first = start if self.first is None else min(self.first, start)
                self.last = start if self.last is None else max(self.last, start)
                self.phrase_labels.add(self.licences.labels[k])

    def _match(self) -> None:
        """A run that could not be prolonged joins the chains it continues."""
        if self.run < MIN_WORDS:
            return
        start, end = self.at - self.run + 1, self.at
        for k, to in self.licences.automaton.ends[self.state]:
            if k >= self.licences.n_phrases:
                self._chain(k, start, end, to - self.run + 1, to)

    def _chain(self, k: int, start: int, end: int, begin: int, to: int) -> None:
        links = self.recent[k]
        while links and links[0][1] < start - MAX_GAP - 1 - self.licences.sizes[k]:
            links.pop(0)
        covered, head = self.run, start
        for other in links:
            if (other[0] <= start and other[1] < end and other[2] <= begin and other[3] < to
                    and start - other[1] - 1 <= MAX_GAP and begin - other[3] - 1 <= MAX_GAP):
                gain = other[4] + min(self.run, end - other[1], to - other[3])
                if gain > covered:
                    covered, head = gain, other[5]
        links.append((start, end, begin, to, covered, head))
        share = covered / self.licences.sizes[k]
        self.best = max(self.best, share)
        if share >= MIN_COVERED:
            self.spans.append((k, head, end, covered))

    def row(self) -> tuple:
        self._match()
        if self.places:
            self.best = 1.0
        sizes, labels, chosen = self.licences.sizes, self.licences.labels, []
        # Of overlapping spans of a licence text the one that covers most stays.
        upto = {}
        for k, head, end, covered in sorted(self.spans, key=lambda s: (s[0], s[1], -s[3], s[2])):
            if k in upto and head <= upto[k][2]:
                if covered > upto[k][3]:
                    chosen[-1] = upto[k] = (k, head, end, covered)
                continue
            upto[k] = (k, head, end, covered)
            chosen.append(upto[k])
        spans = [{"label": labels[k], "template": k - self.licences.n_phrases, "first_word": head,
                  "last_word": end, "covered": covered, "coverage": covered / sizes[k]}
                 for k, head, end, covered in chosen]
        found = self.phrase_labels | {s["label"] for s in spans}
        return (self.n_words, self.places, self.first, self.last, ",".join(sorted(self.phrase_labels)),
                ",".join(sorted(found)), self.best, spans)


def _blocks(raw: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets) of several texts, or of one text in blocks cut between words."""
    if len(offsets) > 2 or len(raw) <= BLOCK_BYTES:
        yield raw, offsets
        return
    start = 0
    while start < len(raw):
        end = min(len(raw), start + BLOCK_BYTES)
        while end < len(raw) and not _BETWEEN[raw[end]]:
            end += 1
        yield raw[start:end], np.array([0, end - start])
        start = end


def scan_texts(column: pa.Array, licences: Licences):
    """One row per text of the column; see ``Scan.row``."""
    for _, text_bytes, text_offsets in shingles.text_slices(column, BLOCK_BYTES):
        scans = [Scan(licences) for _ in range(len(text_offsets) - 1)]
        for raw, offsets in _blocks(shingles.lowered(text_bytes), text_offsets):
            starts, ends = shingles.word_spans(raw, offsets, _BETWEEN)
            bounds = np.searchsorted(starts, offsets, "left")
            edge = np.zeros(len(starts), bool)
            edge[[0, -1] if len(starts) else []] = True
            use = licences.candidates(shingles.hash_words(raw, starts, ends), edge)
            of = np.searchsorted(bounds, use, "right") - 1
            place = use - bounds[of]
            for k, at, a, b in zip(of.tolist(), place.tolist(), starts[use].tolist(), ends[use].tolist()):
                token = licences.ids.get(raw[a:b].tobytes())
                if token is not None:
                    scans[k].word(scans[k].n_words + at, token)
            for scan, n in zip(scans, np.diff(bounds).tolist()):
                scan.n_words += n
        for scan in scans:
            yield scan.row()


SPAN = ("struct<label:string,template:int,first_word:bigint,last_word:bigint,covered:bigint,"
        "coverage:double>")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict | None = None,
         templates: list | None = None) -> DataFrame:
    """(doc_id, n_words, n_places, first_word, last_word, phrase_labels, labels, score, spans).

    ``phrases`` maps wording to label, ``templates`` lists (label, text); the score is the
    largest covered share of a licence text, 1 where a phrase stands."""
    phrases = license_texts.PHRASES if phrases is None else phrases
    templates = license_texts.TEMPLATES if templates is None else templates
    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()),
                      ("last_word", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
             pa.list_(span)]
    names = ["doc_id", "n_words", "n_places", "first_word", "last_word", "phrase_labels", "labels",
             "score", "spans"]

    def run(batches):
        wording = repr((sorted(phrases.items()), templates, MIN_WORDS))
        licences = worker_memory(f"licences {wording}", lambda: Licences(phrases, templates))
        for batch in batches:
            rows = list(zip(*scan_texts(batch.column(1), licences))) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(rows, types))], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_places long, first_word long, last_word long, "
             f"phrase_labels string, labels string, score double, spans array<{SPAN}>")

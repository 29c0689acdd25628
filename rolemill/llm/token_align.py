"""Alignment of two tokenizers by divide and conquer at shared cuts, and corpus counts
of the token pairs it links.

Two token sequences spell the same bytes. Where a token of both ends is a cut. An
interval of tokens looks for a common end near its middle by bisection of the other
side's ends and is split there; both halves are treated alike, all intervals of one
depth at once; an interval without an inner cut is a group. Two tokens are linked if
their bytes overlap; a group of p and q tokens has p + q - 1 links.

A: a byte-level BPE (``tokenizers``) over space + text. B: a sentencepiece BPE, which
adds that space itself. Long texts are encoded in units cut before single spaces, where
no token of either side can cross (checked on B's vocabulary, a property of A's
pre-tokenizer), so a task's memory does not depend on a text's length as long as it has
such spaces; results are those of the whole text.

A text that is null or empty, or that one side does not give back byte for byte, has no
tokens and zeros everywhere; its digest is ''. Rows equal in all columns stay rows of
their own. Extra columns are not read.

Documents travel in slices of ``SLICE_BYTES`` text. A slice's distinct pairs are joined
with the corpus counts of the pairs and return to their slice, so a pair that occurs in
every document costs one row a slice, and no table of pairs is collected or broadcast.
"""

import hashlib
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolemill.llm.tables import keep, worker_memory

# Characters after which a text is cut into units, bytes handled at a time, and bytes
# of text in a slice.
UNIT = 32_768
BLOCK_BYTES = 1 << 19
SLICE_BYTES = 16 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Longer words are not remembered, nor more words than this.
WORD, REMEMBERED = 64, 1 << 19
# New words encoded as one text.
TOGETHER = 256
# Ends tried around the middle before an interval is looked through as a whole.
TRIES = 3


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """A tokenizer: ids of texts, and the bytes each id stands for."""

    def __init__(self, encode, spelled: list[bytes]):
        self.encode, self.spelled = encode, spelled
        self.length = np.array([len(s) for s in spelled], np.int64)
        digits = np.zeros((3, len(spelled), len(str(len(spelled))) + 1), np.uint8)
        for k, separator in enumerate((",", "|", ";")):
            for i in range(len(spelled)):
                text = f"{i}{separator}".encode()
                digits[k, i, :len(text)] = np.frombuffer(text, np.uint8)
        self.digits = digits


def _byte_of_letter() -> dict:
    """The letters by which byte-level vocabularies write bytes: printable ones stand
    for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(path: str) -> Side:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    made.encode_special_tokens = True
    letters = _byte_of_letter()
    size = made.get_vocab_size()
    special = {i for i, t in made.get_added_tokens_decoder().items()}
    spelled = []
    for i in range(size):
        token = made.id_to_token(i) or ""
        spelled.append(token.encode() if i in special else bytes(letters[c] for c in token))
    return Side(lambda texts: [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)],
                spelled)


def pieces(path: str) -> Side:
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for i in range(made.get_piece_size()):
        piece = made.id_to_piece(i)
        if made.is_byte(i):
            spelled.append(bytes([int(piece[3:5], 16)]))
        else:
            if "▁" in piece.lstrip("▁"):
                raise ValueError("a piece goes on after a space: texts cannot be cut there")
            spelled.append(piece.replace("▁", " ").encode())
    return Side(lambda texts: made.encode(texts, num_threads=1), spelled)


class Words:
    """Ids of both sides for words: stretches between single spaces, each taken with
    the space before it. Short words are remembered, up to ``REMEMBERED`` of them."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.ids_a, self.ids_b, self.broken = {}, {}, set()

    def learn(self, words: set) -> None:
        """Every word of ``words`` is known afterwards; ``broken`` ones are not given back
        byte for byte by one side."""
        if len(self.ids_a) > REMEMBERED:
            self.ids_a, self.ids_b, self.broken = {}, {}, set()
        alone, many = [], []
        for w in words:
            if w not in self.ids_a:
                inner = w and not w[0].isspace() and not w[-1].isspace()
                (many if inner else alone).append(w)
        for start in range(0, len(many), TOGETHER):
            some = many[start:start + TOGETHER]
            text = " ".join(some)
            upto = np.cumsum([len(w.encode()) + 1 for w in some])
            left = self._parts(self.a, self.a.encode([" " + text])[0], " " + text, upto)
            right = self._parts(self.b, self.b.encode([text])[0], " " + text, upto)
            if left is None or right is None:
                alone += some
            else:
                self.ids_a.update(zip(some, left))
                self.ids_b.update(zip(some, right))
        for w, left, right in zip(alone, self.a.encode([" " + w for w in alone]), self.b.encode(alone)):
            own = (" " + w).encode()
            if (b"".join(map(self.a.spelled.__getitem__, left)) != own
                    or b"".join(map(self.b.spelled.__getitem__, right)) != own):
                self.broken.add(w)
            self.ids_a[w], self.ids_b[w] = array("I", left).tobytes(), array("I", right).tobytes()

    @staticmethod
    def _parts(side: Side, ids: list, text: str, upto: np.ndarray) -> list[bytes] | None:
        """The ids of each word of a text of words, or None if it is not given back."""
        if b"".join(map(side.spelled.__getitem__, ids)) != text.encode():
            return None
        ids = np.array(ids, np.uint32)
        ends = np.cumsum(side.length[ids])
        at = np.searchsorted(ends, upto)
        if (ends[at] != upto).any():
            return None
        raw, bounds = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
        return [raw[x:y] for x, y in zip(bounds, bounds[1:])]

    def forget(self, words: set) -> None:
        for w in words:
            if len(w) > WORD:
                del self.ids_a[w], self.ids_b[w]
                self.broken.discard(w)


def words_of(paths: tuple[str, str]) -> Words:
    return worker_memory(f"align {paths}", lambda: Words(byte_level(paths[0]), pieces(paths[1])))


def units(text: str) -> list[str]:
    """The text in pieces; each but the first has lost the space before it."""
    out, start = [], 0
    while len(text) - start > UNIT and (cut := _CUT.search(text, start + UNIT)):
        out.append(text[start:cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def divide(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray):
    """Groups (a from, a to, b from, b to) of tokens between shared cuts.

    ``first_*`` say where each interval to start with begins (one more at the end);
    intervals begin and end at shared cuts. Ends ascend strictly."""
    todo = np.stack([first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]])
    done = []
    while todo.shape[1]:
        leaf = (todo[1] - todo[0] < 2) | (todo[3] - todo[2] < 2)
        done.append(todo[:, leaf])
        todo = todo[:, ~leaf]
        low, high = todo[0], todo[1] - 2  # inner ends are those of low..high
        middle = (low + high) >> 1
        cut_a = np.full(len(low), -1, np.int64)
        cut_b = cut_a.copy()
        open_ = np.arange(len(low))
        for k in range(TRIES):
            at = middle[open_] + ((k + 1) // 2 if k % 2 else -(k // 2))
            inside = (at >= low[open_]) & (at <= high[open_])
            at, which = at[inside], open_[inside]
            place = np.searchsorted(ends_b, ends_a[at])
            hit = ends_b[place] == ends_a[at]
            cut_a[which[hit]], cut_b[which[hit]] = at[hit], place[hit]
            open_ = open_[cut_a[open_] < 0]
        if len(open_):  # look through the whole interval, nearest to the middle first
            count = high[open_] - low[open_] + 1
            begin = np.concatenate([[0], np.cumsum(count)])
            of = np.repeat(np.arange(len(open_)), count)
            at = np.arange(begin[-1]) - begin[of] + low[open_][of]
            place = np.searchsorted(ends_b, ends_a[at])
            far = np.where(ends_b[place] == ends_a[at], np.abs(at - middle[open_][of]), len(ends_a))
            best = np.minimum.reduceat(far, begin[:-1])
            hit = np.flatnonzero((far == best[of]) & (far < len(ends_a)))
            cut_a[open_[of[hit]]], cut_b[open_[of[hit]]] = at[hit], place[hit]
        split = cut_a >= 0
        done.append(todo[:, ~split])
        whole, cut_a, cut_b = todo[:, split], cut_a[split] + 1, cut_b[split] + 1
        todo = np.concatenate([np.stack([whole[0], cut_a, whole[2], cut_b]),
                               np.stack([cut_a, whole[1], cut_b, whole[3]])], axis=1)
    groups = np.concatenate(done, axis=1)
    return groups[:, np.argsort(groups[0], kind="stable")]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens whose bytes overlap, as places of both."""
    over = np.searchsorted(ends_b, ends_a)
    under = np.searchsorted(ends_a, ends_b)
    alone = np.flatnonzero(ends_a[under] != ends_b)
    return (np.concatenate([np.arange(len(ends_a)), under[alone]]), np.concatenate([over, alone]))


class Aligned:
    """What is known of a text while its units pass by."""

    def __init__(self):
        self.whole, self.n_a, self.n_b, self.n_groups = True, 0, 0, 0
        self.digest, self.codes, self.counts = hashlib.sha256(), [], []

    def compact(self) -> None:
        """Pairs of several units as one list."""
        if len(self.codes) > 1:
            codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
            counts = np.zeros(len(codes), np.int64)
            np.add.at(counts, at, np.concatenate(self.counts))
            self.codes, self.counts = [codes], [counts]

    def row(self) -> tuple:
        if not self.whole or not self.n_a:
            return 0, 0, 0, 0, "", b"", b""
        self.compact()
        return (self.n_a, self.n_b, self.n_groups, self.n_a + self.n_b - self.n_groups,
                self.digest.hexdigest(), self.codes[0].astype("<u4").tobytes(),
                self.counts[0].astype("<u4").tobytes())


def align_block(texts: list[str], owners: list[Aligned], memory: Words) -> None:
    """Adds units (first unit of a text: as it is; each belongs to an ``Aligned``)."""
    a, b, split = memory.a, memory.b, [_CUT.split(t) for t in texts]
    distinct = set(chain.from_iterable(split))
    memory.learn(distinct)
    if memory.broken and not memory.broken.isdisjoint(distinct):
        for own, words in zip(owners, split):
            own.whole &= memory.broken.isdisjoint(words)
    good = [k for k in range(len(texts)) if owners[k].whole]
    sizes, flat = [], []
    for known in (memory.ids_a, memory.ids_b):
        ids = [b"".join(map(known.__getitem__, split[k])) for k in good]
        sizes.append(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64))
        flat.append(np.frombuffer(b"".join(ids), np.uint32).astype(np.int64))
    memory.forget(distinct)
    if not good:
        return
    (first_a, first_b), (ids_a, ids_b) = sizes, flat
    ends_a, ends_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
    groups = divide(ends_a, ends_b, first_a, first_b)
    # Digest: A's tokens of a group, then B's.
    size_a, size_b = groups[1] - groups[0], groups[3] - groups[2]
    of_a, of_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    after_a, after_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    after_a[groups[1] - 1], after_b[groups[3] - 1] = 1, 2
    written = np.empty((len(ids_a) + len(ids_b), a.digits.shape[2]), np.uint8)
    written[np.arange(len(ids_a)) + groups[2][of_a]] = a.digits[after_a, ids_a]
    written[np.arange(len(ids_b)) + groups[1][of_b], :b.digits.shape[2]] = b.digits[after_b, ids_b]
    if b.digits.shape[2] < written.shape[1]:
        written[np.arange(len(ids_b)) + groups[1][of_b], b.digits.shape[2]:] = 0
    used = written != 0
    letters = written[used].tobytes()
    upto = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[first_a + first_b].tolist()
    group_at = np.searchsorted(groups[0], first_a).tolist()
    # Links of each unit, counted by pair of ids.
    at_a, at_b = links(ends_a, ends_b)
    unit = np.searchsorted(first_a, at_a, "right") - 1
    key = (unit << 32) | (ids_a[at_a] * len(b.spelled) + ids_b[at_b])
    key, count = np.unique(key, return_counts=True)
    code_at = np.searchsorted(key, np.arange(len(good) + 1) << 32).tolist()
    code = key & 0xFFFFFFFF
    for n, k in enumerate(good):
        own = owners[k]
        if own.n_a:
            own.digest.update(b";")
        own.digest.update(letters[upto[n]:upto[n + 1] - 1])
        own.n_a += int(first_a[n + 1] - first_a[n])
        own.n_b += int(first_b[n + 1] - first_b[n])
        own.n_groups += group_at[n + 1] - group_at[n]
        own.codes.append(code[code_at[n]:code_at[n + 1]])
        own.counts.append(count[code_at[n]:code_at[n + 1]])


def aligned(texts, memory: Words):
    """One row per text; see ``Aligned.row``. Rows come in order, some texts late."""
    waiting, part, owners, size = [], [], [], 0
    for text in texts:
        own = Aligned()
        waiting.append(own)
        for unit in units(text) if text else []:
            part.append(unit)
            owners.append(own)
            size += len(unit) + 1
            if size >= BLOCK_BYTES:
                align_block(part, owners, memory)
                part, owners, size = [], [], 0
                for ready in waiting[:-1]:
                    yield ready.row()
                waiting = waiting[-1:]
                waiting[0].compact()
    if part:
        align_block(part, owners, memory)
    for ready in waiting:
        yield ready.row()


def align(docs: DataFrame, key: str = "doc_id", text: str = "text",
          paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    paths = paths or default_paths()
    from pyspark import TaskContext

    names = ["slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "counts"]
    types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches):
        memory = words_of(paths)
        number, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for k, row in enumerate(aligned((t.as_py() for t in batch.column(1)), memory)):
                rows.append((number, ids[k], *row))
                size += len(batch.column(1)[k].as_py() or "") + 64
                if size >= SLICE_BYTES:
                    number, size = number + 1, 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), types)], names=names)

    made = keep(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
             "groups_sha256 string, codes binary, counts binary"))

    def used(batches):
        for batch in batches:
            slices = np.repeat(batch.column(0).to_numpy(), [len(c.as_buffer() or b"") // 4 for c in batch.column(1)])
            codes, counts = (np.frombuffer(b"".join(c.as_py() for c in batch.column(k)), "<u4").astype(np.int64)
                             for k in (1, 2))
            order = np.lexsort((codes, slices))
            slices, codes, counts = slices[order], codes[order], counts[order]
            fresh = np.flatnonzero(np.append(True, (slices[1:] != slices[:-1]) | (codes[1:] != codes[:-1]))[:len(codes)])
            total = np.add.reduceat(counts, fresh) if len(fresh) else counts
            yield pa.RecordBatch.from_arrays(
                [pa.array(slices[fresh]), pa.array(codes[fresh]), pa.array(total)], names=["slice", "code", "n"])

    uses = keep(made.where("n_a > 0").select("slice", "codes", "counts").mapInArrow(
        used, "slice long, code long, n long"))
    b_id = (F.col("code") % F.lit(_pieces(paths)))
    counted = uses.groupBy("code").agg(F.sum("n").alias("n")).withColumn(
        "best", F.col("n") == F.max("n").over(Window.partitionBy(b_id)))
    known = uses.select("slice", "code").join(counted, "code").select("slice", "code", "n", "best")

    def summed(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        codes = pairs.column("code").to_numpy()
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], pairs.column("n").to_numpy()[order]
        best = pairs.column("best").to_numpy()[order]
        n_best, count_sum = [], []
        for own, times in zip(texts.column("codes"), texts.column("counts")):
            own, times = (np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in (own, times))
            at = np.searchsorted(codes, own)
            n_best.append(int(times[best[at]].sum()) if len(own) else 0)
            count_sum.append(int((times * n[at]).sum()) if len(own) else 0)
        return texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column(
            "n_best", pa.array(n_best, pa.int64())).append_column(
            "count_sum", pa.array(count_sum, pa.int64())).append_column(
            "groups_sha256", texts.column("groups_sha256"))

    return made.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(
        summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                "count_sum long, groups_sha256 string")


def _pieces(paths: tuple[str, str]) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()

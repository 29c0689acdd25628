"""Cost-balanced packing of token sequences.

Full-length pieces of a document fill a sequence each. What is left of the documents
goes, in blocks, longest first, to the sequence of least cost that still has room;
the cost of a piece is linear plus quadratic in its length, as in attention that
stays within a piece. A piece that fits nowhere is cut into the free places, so a
block leaves less than one sequence unfilled; that remainder becomes sequences whose
lengths are powers of two and need no padding.

Packing runs where the texts are read, without a shuffle. A block ends with its
task's rows or when it is full, so memory is bounded. Ids of sequences hold the task
and a number in it: a task that runs again gives the same ones.

A null text is empty and has one id, the end mark. Equal rows are packed one by one.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm import bpe

CAPACITY = 2048
END_ID = 1
# Tokens of one packing block; about 2,000 sequences.
BLOCK_TOKENS = 4 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(item, from, length, bin) pieces of ``lengths`` in the fewest bins that hold
    them all, evenly costly. All bins are filled, the last one to what is left."""
    total = int(lengths.sum())
    bins = -(-total // capacity)
    room = np.full(bins, capacity, np.int64)
    if bins:
        room[-1] -= bins * capacity - total
    cost = np.zeros(bins)
    pieces, cut = [], []
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fits = np.where(room >= n, cost, np.inf)
        b = int(fits.argmin())
        if fits[b] == np.inf:
            cut.append((item, n))
            continue
        pieces.append((item, 0, n, b))
        room[b] -= n
        cost[b] += LINEAR * n + QUADRATIC * n * n
    free = np.flatnonzero(room).tolist()
    for item, n in cut:
        at = 0
        while n:
            b = free[-1]
            take = min(int(room[b]), n)
            pieces.append((item, at, take, b))
            at, n = at + take, n - take
            room[b] -= take
            if not room[b]:
                free.pop()
    return pieces


def powers(total: int) -> list[int]:
    """Powers of two, descending, whose sum is ``total``."""
    return [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]


def _sequences(pieces, fill: dict[int, int], capacity: int):
    """(item, from, length, sequence, offset, sequence length), sequences from 0."""
    by_bin: dict[int, list] = {}
    for item, at, n, b in pieces:
        by_bin.setdefault(b, []).append((item, at, n))
    number = 0
    for b in sorted(by_bin):
        sizes = [capacity] if fill[b] == capacity else powers(fill[b])
        k, used = 0, 0
        for item, at, n in by_bin[b]:
            while n:
                take = min(n, sizes[k] - used)
                yield item, at, take, number + k, used, sizes[k]
                at, n, used = at + take, n - take, used + take
                if used == sizes[k]:
                    k, used = k + 1, 0
        number += len(sizes)


class _Block:
    """Documents of one task that are packed together."""

    def __init__(self, capacity: int, task: int):
        self.capacity, self.next, self.task = capacity, task << 32, task
        self.clear()

    def clear(self):
        self.docs, self.sizes, self.tokens, self.rest = [], [], 0, []
        self.rows = []

    def _emit(self, doc, ids, start, n, sequence, offset, length):
        crc = zlib.crc32(ids[start:start + n])
        self.rows.append((doc, start, n, crc, len(ids), sequence, offset, length))

    def add(self, doc, ids: np.ndarray):
        full = len(ids) // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            self._emit(doc, ids, start, self.capacity, self.next, 0, self.capacity)
            self.next += 1
        if full < len(ids):
            self.rest.append((doc, ids, full))
            self.tokens += len(ids) - full

    def pack(self) -> pa.RecordBatch:
        lengths = np.array([len(ids) - full for _, ids, full in self.rest], np.int64)
        pieces = assign(lengths, self.capacity)
        fill: dict[int, int] = {}
        for _, _, n, b in pieces:
            fill[b] = fill.get(b, 0) + n
        last = self.next
        for item, at, n, number, offset, length in _sequences(pieces, fill, self.capacity):
            doc, ids, full = self.rest[item]
            self._emit(doc, ids, full + at, n, self.next + number, offset, length)
            last = self.next + number + 1
        self.next = last
        columns = list(zip(*self.rows)) or [[]] * 8
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=names)
        self.clear()
        return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None,
         block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: its document, place, checksum, sequence and offset there.

    ``capacity`` is a power of two. ``key`` is an integer column and may be null."""
    def run(batches):
        block = _Block(capacity, TaskContext.get().partitionId())
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, ids, begin in bpe.encoded_slices(batch.column(1), path):
                ids = ids.astype("<u4")
                for k in range(len(begin) - 1):
                    own = np.append(ids[begin[k]:begin[k + 1]], np.uint32(end_id))
                    block.add(keys[at + k], own.astype("<u4"))
                    if block.tokens >= block_tokens or len(block.rows) >= 50_000:
                        yield block.pack()
        yield block.pack()

    return docs.select(F.col(key).cast("long").alias("doc_id"),
                       F.col(text).alias("text")).mapInArrow(run, SCHEMA)

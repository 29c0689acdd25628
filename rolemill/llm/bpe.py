"""BPE encoding and decoding with a public tokenizer file.

Texts are encoded word by word, as white space always separates tokens here: equal
words of a batch are encoded once and remembered by the worker. Texts over ``unit``
characters are cut into halves again and again, wherever the cut falls; the leaves
are encoded in parallel and concatenated as a tree. Around each join a window of
text is encoded again and grown until it shares tokens with both sides, which makes
the concatenation equal to the encoding of the whole.

Nulls count as empty texts and give no ids. Rows are kept as they are, with equal
rows and null keys; a text's ids depend on the text alone.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.llm import shingles
from rolemill.llm.tables import worker_memory

# Texts longer than this are encoded in halves.
UNIT = 16_384
# Distinct words a worker remembers before it starts anew.
REMEMBERED = 1_000_000
SLICE_BYTES = 2 << 20
# Tokens at either end of a part whose places travel with it, for the joins.
EDGE = 256
# Leaves joined in one task; a power of two. Longer texts take further shuffles.
FAN = 8


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _loaded(path: str | None):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path or default_path())
    made.no_truncation()
    made.no_padding()
    return made


def tokenizer(path: str | None):
    """The tokenizer of a file, without truncation and padding; one per worker."""
    return worker_memory(f"tokenizer {path}", lambda: _loaded(path))


class WordEncoder:
    """Ids of many texts, encoding each distinct word once."""

    def __init__(self, path: str | None):
        self.tokenizer = tokenizer(path)
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int32)
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        got = [x.ids for x in
               self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, got), np.int64, len(got))
        total = int(length.sum())
        if self.used + total > len(self.ids):
            grown = np.zeros(2 * (self.used + total), np.uint32)
            grown[:self.used] = self.ids[:self.used]
            self.ids = grown
        self.ids[self.used:self.used + total] = np.fromiter(
            (i for ids in got for i in ids), np.uint32, total)
        start = self.used + np.cumsum(length) - length
        self.used += total
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.start = np.insert(self.start, at, start)
        self.length = np.insert(self.length, at, length)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray):
        """Ids of all texts one after the other, and where each text's begin."""
        starts, ends = shingles.word_spans(raw, offsets)
        first = np.searchsorted(starts, offsets, "left")
        if not len(starts):
            return np.zeros(0, np.uint32), first
        low = shingles.lowered(raw)
        marks = np.flatnonzero(raw == 0x3C)  # special tokens are spelled exactly
        for k in np.unique(np.searchsorted(starts, marks, "right") - 1):
            low[starts[k]:ends[k]] = raw[starts[k]:ends[k]]
        hashes, index, back = np.unique(
            shingles.hash_words(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            self._learn(hashes[new], [
                raw[starts[i]:ends[i]].tobytes().decode() for i in index[new]])
            at = np.searchsorted(self.known, hashes)
        at = at[back]
        length = self.length[at].astype(np.int64)
        end = np.cumsum(length)
        total = int(end[-1])
        where = np.repeat(self.start[at] - (end - length), length) + np.arange(total)
        return self.ids[where], np.concatenate([[0], end])[first]


def word_encoder(path: str | None) -> WordEncoder:
    return worker_memory(f"words {path}", lambda: WordEncoder(path))


def encoded_slices(column: pa.Array, path: str | None):
    """(first row, ids, where each row's ids begin) for the texts of a column."""
    encode = word_encoder(path)
    for at, raw, offsets in shingles.text_slices(column, SLICE_BYTES):
        yield at, *encode(raw, offsets)


def _binary(chunks: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Rows of little-endian unsigned 32-bit ids."""
    data = np.concatenate([c[0] for c in chunks] or [np.zeros(0, np.uint32)])
    ends, base = [np.zeros(1, np.int64)], 0
    for ids, begin in chunks:
        ends.append(begin[1:] + base)
        base += len(ids)
    offsets = np.concatenate(ends) * 4
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int64)),
         pa.py_buffer(np.ascontiguousarray(data, "<u4"))]).cast(pa.binary())


def _spans(made, shift: int = 0):
    """Ids of an encoding and the characters (from, to) that each stands for."""
    spans = np.array(made.offsets, np.int64).reshape(-1, 2) + shift
    return np.array(made.ids, np.int64), spans


def _common(a_ids, a_spans, b_ids, b_spans, last: bool):
    """Positions of two neighbouring tokens that both encodings have at the same
    characters: the last such pair of a, or the first."""
    a_at, b_at = (np.flatnonzero(x[:, 0] >= 0) for x in (a_spans, b_spans))
    a_ids, a_spans, b_ids, b_spans = a_ids[a_at], a_spans[a_at], b_ids[b_at], b_spans[b_at]
    width = int(max(a_spans.max(initial=0), b_spans.max(initial=0))) + 1
    a = (a_ids * width + a_spans[:, 0]) * width + a_spans[:, 1]
    b = (b_ids * width + b_spans[:, 0]) * width + b_spans[:, 1]
    _, i, j = np.intersect1d(a, b, return_indices=True)
    where = dict(zip(a_at[i].tolist(), b_at[j].tolist()))
    for k in sorted(where, reverse=last):
        if where.get(k + 1) == where[k] + 1:
            return k + 1, where[k] + 1
    return None


def _edges(spans: np.ndarray) -> bytes:
    """The spans of the first and last tokens."""
    if len(spans) > 2 * EDGE:
        spans = np.concatenate([spans[:EDGE], spans[-EDGE:]])
    return spans.astype("<i4").tobytes()


def _with_edges(edges: bytes, n: int) -> np.ndarray:
    """Spans of n tokens, -1 where they did not travel."""
    known = np.frombuffer(edges, "<i4").reshape(-1, 2).astype(np.int64)
    if len(known) == n:
        return known
    spans = np.full((n, 2), -1, np.int64)
    spans[:EDGE], spans[n - EDGE:] = known[:EDGE], known[EDGE:]
    return spans


def join_encoded(tok, left, right, window: int = 32):
    """The encoding of two neighbouring texts; each side is (text, ids, spans)."""
    (a_text, a_ids, a_spans), (b_text, b_ids, b_spans) = left, right
    cut, whole = len(a_text), a_text + b_text
    b_moved = np.where(b_spans < 0, -1, b_spans + cut)
    while True:
        lo, hi = max(0, cut - window), min(len(whole), cut + window)
        ids, spans = _spans(tok.encode(whole[lo:hi], add_special_tokens=False), lo)
        head = (0, 0) if lo == 0 else _common(a_ids, a_spans, ids, spans, True)
        tail = ((len(b_ids), len(ids)) if hi == len(whole)
                else _common(b_ids, b_moved, ids, spans, False))
        if head and tail and head[1] <= tail[1]:
            i, k = head
            j, m = tail
            return (whole, np.concatenate([a_ids[:i], ids[k:m], b_ids[j:]]),
                    np.concatenate([a_spans[:i], spans[k:m], b_moved[j:]]))
        window *= 2


def _leaf_count(n_chars, unit: int):
    """Leaves of a text: a power of two, so that every join has two sides."""
    return F.pow(F.lit(2), F.ceil(F.log2(n_chars / F.lit(unit)))).cast("int")


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where all are small enough, after a mark."""
    small = not len(ids) or ids.max() < 1 << 16
    return (b"2" + ids.astype("<u2").tobytes() if small
            else b"4" + ids.astype("<u4").tobytes())


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"2" else "<u4", offset=1).astype(np.int64)


def _tree(long: DataFrame, keys: list, unit: int, path: str | None) -> DataFrame:
    """Long texts by halves: the key columns ``_0`` .. and ``ids``."""
    node = T.StructType([
        T.StructField("_key", T.LongType()), *keys, T.StructField("_node", T.IntegerType()),
        T.StructField("_nodes", T.IntegerType()), T.StructField("text", T.StringType()),
        T.StructField("ids", T.BinaryType()), T.StructField("spans", T.BinaryType())])

    def leaves(batches):
        tok = tokenizer(path)
        for batch in (b.slice(i, 128) for b in batches for i in range(0, len(b), 128)):
            ids_out, spans_out = [], []
            for text in batch.column(batch.schema.names.index("text")).to_pylist():
                ids, spans = _spans(tok.encode(text, add_special_tokens=False))
                ids_out.append(_narrow(ids))
                spans_out.append(_edges(spans))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids_out, pa.binary()), pa.array(spans_out, pa.binary())],
                names=[*batch.schema.names, "ids", "spans"])

    def joined(table: pa.Table) -> pa.Table:
        """The parts of one text, neighbours with neighbours until one is left. A
        whole text's row holds its final ids and no text."""
        if table.column("_nodes")[0].as_py() == 1:
            return table
        table = table.sort_by("_node").combine_chunks()
        sides = []
        for text, ids, spans in zip(*(table.column(c).to_pylist()
                                      for c in ("text", "ids", "spans"))):
            ids = _wide(ids)
            sides.append((text, ids, _with_edges(spans, len(ids))))
        levels = len(sides).bit_length() - 1
        while len(sides) > 1:
            sides = [join_encoded(tokenizer(path), *sides[i:i + 2])
                     for i in range(0, len(sides), 2)]
        text, ids, spans = sides[0]
        nodes = table.column("_nodes")[0].as_py() >> levels
        own = {"_node": table.column("_node")[0].as_py() >> levels, "_nodes": nodes}
        own |= ({"text": None, "ids": ids.astype("<u4").tobytes(), "spans": None}
                if nodes == 1 else
                {"text": text, "ids": _narrow(ids), "spans": _edges(spans)})
        return pa.Table.from_arrays(
            [pa.array([own[f.name]], f.type) if f.name in own
             else table.column(f.name).slice(0, 1) for f in table.schema], schema=table.schema)

    names = [f.name for f in keys]
    size = F.ceil(F.length("text") / F.col("_nodes")).cast("int")
    cut = (long.withColumn("_nodes", _leaf_count(F.length("text"), unit))
           .withColumn("_node", F.explode(F.sequence(F.lit(0), F.col("_nodes") - 1)))
           .select("_key", *names, "_node", "_nodes",
                   F.substring(F.col("text"), F.col("_node") * size + 1, size).alias("text"))
           .repartition("_key", "_node"))
    deepest = long.agg(F.max(_leaf_count(F.length("text"), unit))).first()[0] or 1
    level = cut.mapInArrow(leaves, node)
    while deepest > 1:
        level = level.groupBy("_key", F.floor(F.col("_node") / FAN).alias("_pair")) \
            .applyInArrow(joined, node)
        deepest //= FAN
    return level.select(*names, "ids")


def encode(docs: DataFrame, text: str = "text", path: str | None = None,
           unit: int = UNIT) -> DataFrame:
    """``docs`` without ``text``, with ``ids``: little-endian unsigned 32-bit ids."""
    keys = [f for f in docs.schema.fields if f.name not in (text, "ids")]
    inner = [T.StructField(f"_{i}", f.dataType) for i, f in enumerate(keys)]
    value = F.coalesce(F.col(text), F.lit(""))
    columns = [F.col(f.name).alias(g.name) for f, g in zip(keys, inner)]

    def plain(batches):
        for batch in batches:
            for at, ids, begin in encoded_slices(batch.column(len(inner)), path):
                part = batch.slice(at, len(begin) - 1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(inner)], _binary([(ids, begin)])],
                    names=[*[g.name for g in inner], "ids"])

    short = (docs.where(F.length(value) <= unit).select(*columns, value.alias("text"))
             .mapInArrow(plain, T.StructType([*inner, T.StructField("ids", T.BinaryType())])))
    long = docs.where(F.length(text) > unit).select(
        F.monotonically_increasing_id().alias("_key"), *columns, F.col(text).alias("text"))
    out = short.unionByName(_tree(long, inner, unit, path))
    return out.select(*[F.col(g.name).alias(f.name) for f, g in zip(keys, inner)], "ids")


def _by_bytes(batch: pa.RecordBatch, column: int, size: int = 1 << 20):
    """Slices of a batch whose binary column holds about ``size`` bytes each."""
    start = held = 0
    for row, value in enumerate(batch.column(column)):
        held += len(value.as_buffer())
        if held >= size:
            yield batch.slice(start, row + 1 - start)
            start, held = row + 1, 0
    if start < len(batch):
        yield batch.slice(start)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the tokenizer's text of ``ids`` with special
    tokens. The tokenizer's file names no decoder: its text is the tokens in order
    with a space between, taken from its own table."""
    at = encoded.columns.index("ids")
    schema = T.StructType(encoded.schema.fields + [T.StructField("decoded", T.StringType())])

    def table():
        tok = _loaded(path)  # not kept: the table is enough
        if tok.decoder is not None:
            return None
        return [tok.id_to_token(i) for i in range(tok.get_vocab_size())]

    def run(batches):
        spelled = worker_memory(f"tokens {path}", table)
        for batch in (part for b in batches for part in _by_bytes(b, at)):
            out = []
            for b in batch.column(at):
                ids = np.frombuffer(b.as_buffer(), "<u4").tolist()
                out.append(" ".join([spelled[i] for i in ids]) if spelled is not None
                           else tokenizer(path).decode(ids, skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.string())],
                names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def ids_sha256(ids: np.ndarray) -> str:
    """The digest the query gives, for tests."""
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()

"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once."""

import hashlib

import numpy as np
import pyarrow as pa

# Words longer than this are hashed one by one; the rest in 8-byte lanes.
LONG_WORD = 512
# Texts are handled in slices of about this many bytes, so that memory depends
# on the longest text and not on the batch.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, size: int = SLICE_BYTES):
    """(first row, bytes, offsets) of a string column; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(n, max(end, start + 1))
        part = offsets[start:end + 1]
        yield start, raw[part[0]:part[-1]], part - part[0]
        start = end


def word_spans(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE):
    """Where each word begins and ends; no word crosses from one text to the next.
    ``between`` says of each byte whether it separates words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = between[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    return (np.flatnonzero(~space & (before | edge[:-1])),
            np.flatnonzero(~space & (after | edge[1:])) + 1)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes, also those of longer characters, as they are."""
    return _LOWER[raw]


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word."""
    lengths = ends - starts
    hashes = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(starts):
        return hashes
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(
        padded, (len(raw), 8), (1, 1), writeable=False)
    todo = np.flatnonzero(lengths <= LONG_WORD)
    at = 0
    while len(todo):
        lane = lanes[starts[todo] + at].view(np.uint64)[:, 0]
        left = np.minimum(lengths[todo] - at, 8)
        hashes[todo] = mix((hashes[todo] ^ (lane & _KEEP[left]))
                           * np.uint64(0x9FB21C651E98DF25))
        at += 8
        todo = todo[lengths[todo] > at]
    for k in np.flatnonzero(lengths > LONG_WORD):
        word = raw[starts[k]:ends[k]].tobytes()
        hashes[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashes


def word_hashes(raw: np.ndarray, offsets: np.ndarray):
    """Hash of each word in lower case, and at which word each text begins (one
    more at the end)."""
    raw = lowered(raw)
    starts, ends = word_spans(raw, offsets)
    return hash_words(raw, starts, ends), np.searchsorted(starts, offsets, "left")


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int):
    """The distinct shingle hashes of all texts, ascending within each text, and
    where each text's begin (one more at the end). A text with fewer words has its
    whole sequence as the only shingle; one without words has none."""
    hashes, first = word_hashes(raw, offsets)
    n = len(offsets) - 1
    count = np.diff(first)
    made = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(n), made)
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(begin[-1]) - begin[text] + first[text]
    width = np.minimum(count, words)[text]
    out = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64) + width.astype(np.uint64)
    for k in range(words):
        use = np.flatnonzero(width > k) if (width <= k).any() else slice(None)
        out[use] = mix((out[use] ^ hashes[at[use] + k]) * np.uint64(0x9FB21C651E98DF25))
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    out, text = out[fresh], text[fresh]
    return out, np.searchsorted(text, np.arange(n + 1), "left")

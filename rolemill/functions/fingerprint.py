"""Posting fingerprints."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill import vocab
from rolemill.functions.text import normalize_company, normalize_title, strip

_LANES = 0x0000000100000001


def canonical_hash(title: Column, company: Column, city: Column,
                   state: Column) -> Column:
    """SHA-1 of the normalised title, employer and place."""
    return normalized_hash(normalize_title(title), normalize_company(company), city, state)


def normalized_hash(title: Column, company: Column, city: Column, state: Column) -> Column:
    """``canonical_hash`` of a title and an employer that are normalised already."""
    return F.sha1(F.concat_ws(
        "|", title, company,
        F.lower(strip(F.coalesce(city, F.lit("")))),
        F.upper(strip(F.coalesce(state, F.lit(""))))))


# Words whose bits are held unpacked at once, 64 bytes each.
_SLICE_WORDS = 32_768
_KNOWN_WORDS = 200_000


class _TokenHashes(dict):
    """Hashes of the words seen last."""

    def __missing__(self, token: str) -> bytes:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        h = self[token] = hashlib.md5(token.encode()).digest()[:8]
        return h


class _Gaps(dict):
    """For ``str.translate``: what ``vocab.WORD`` does not hold becomes a blank."""

    def __missing__(self, code: int) -> str:
        char = self[code] = chr(code) if _WORD_CHARACTER.match(chr(code)) else " "
        return char


_WORD_CHARACTER = re.compile(vocab.WORD)
_HASHES, _GAPS = _TokenHashes(), _Gaps()


def _ones(raw: bytes) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)
    return sum(np.unpackbits(bits[i:i + _SLICE_WORDS], axis=1).sum(axis=0, dtype=np.int64)
               for i in range(0, len(bits), _SLICE_WORDS))


def _packed(raws: list) -> list:
    """Fingerprints of several texts' hashes, with one unpacking."""
    counts = np.array([len(r) // 8 for r in raws])
    if len(raws) == 1:
        sums = _ones(raws[0])[None, :]
    else:
        bits = np.unpackbits(np.frombuffer(b"".join(raws), dtype=np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, np.concatenate(([0], counts.cumsum()[:-1])), axis=0,
                               dtype=np.int32)
    heavy = np.packbits(2 * sums > counts[:, None], axis=1)
    return heavy.view(">i8").ravel().tolist()


def simhashes(texts: pa.Array) -> pa.Array:
    """Simhashes of lower-cased texts."""
    out, at, raws, waiting = [None] * len(texts), [], [], 0
    for i, text in enumerate(texts):
        tokens = text.as_py().translate(_GAPS).split() if text.is_valid else []
        if len(tokens) < vocab.MIN_SIMHASH_TOKENS:
            continue
        if raws and waiting + len(tokens) > _SLICE_WORDS:
            for j, value in zip(at, _packed(raws)):
                out[j] = value
            at, raws, waiting = [], [], 0
        at.append(i)
        raws.append(b"".join(map(_HASHES.__getitem__, tokens)))
        waiting += len(tokens)
    if raws:
        for j, value in zip(at, _packed(raws)):
            out[j] = value
    return pa.array(out, pa.int64())


# Not an iterator: Spark runs it in one step with other helpers that read the same text.
@F.arrow_udf(T.LongType())
def _simhash(texts: pa.Array) -> pa.Array:
    return simhashes(texts)


def simhash(text: Column) -> Column:
    """64-bit simhash over word unigrams as BIGINT; NULL under four words.

    Row-local: no shuffle, and each Python worker hashes a word once.
    """
    return _simhash(F.lower(text))


def simhash_by_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash) from built-in expressions only.

    Words are exploded, hashed once per distinct (key, word), and 64 counters
    are kept as 32 sums with two 32-bit lanes each. The partial aggregate turns
    every row's words back into one record before anything is shuffled.
    """
    words = df.select(key, F.explode(F.regexp_extract_all(
        F.lower(F.col(text)), F.lit(vocab.WORD), F.lit(0))).alias("w"))
    hashed = words.select(key, F.conv(F.substring(F.md5("w"), 1, 16), 16, -10)
                          .cast("bigint").alias("h"))
    sums = hashed.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES)))
          .alias(f"s{i}") for i in range(32)])
    value = F.lit(0).cast("bigint")
    for i in range(32):
        low = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"s{i}", 32)
        for lane, bit in ((low, i), (high, i + 32)):
            value = value.bitwiseOR(
                F.when(lane * 2 > F.col("n"),
                       F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(0))
    return sums.select(key, F.when(F.col("n") >= vocab.MIN_SIMHASH_TOKENS, value)
                       .alias("simhash"))


def simhash_hex(value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(
        F.lpad(F.lower(F.hex(value)), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; 64 when either fingerprint is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def simhash_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0), F.lit(0.0))


def source_depth(source_key: Column) -> Column:
    depth = F.when(F.lit(False), 0)
    for source, rank in vocab.SOURCE_DEPTH.items():
        depth = depth.when(source_key == source, rank)
    return depth.otherwise(0)

"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and beginnings of words learns from confirmed toxic examples and from
unlabelled text. With the class prior ``p``, the risk is
``p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic))``: unlabelled text counts as
clean, less the toxic share it holds, and that difference is kept from turning
negative. The prior is the toxic share of the labelled training rows; after training
the offset is set so that as large a share of the unlabelled text scores 0.5 or more.

Training takes at most ``MAX_TOXIC`` toxic and ``MAX_UNLABELLED`` unlabelled rows,
chosen by a hash of their key; every whole text is scored. Rows of the held-out fold
(crc32 of the key mod ``FOLDS`` is 0) are never trained on. Null and empty texts have
no words and get the score of the offset alone. Null keys are scored, not trained on;
repeated keys and rows are scored one by one.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.llm import shingles

FOLDS = 5
BITS = 20
MAX_TOXIC = 4_000
MAX_UNLABELLED = 12_000
# Beginnings of words that count besides the words, in bytes; inflected words share them.
BEGINNINGS = (5, 6, 7, 8)
# A feature must be in this many toxic texts, and this many standard errors more often
# than in unlabelled ones, to have a weight.
MIN_TEXTS = 5
MIN_LIFT = 5.0
STEPS = 250
RATE = 0.05
L2 = 3e-4

# Words here are runs of letters and digits; bytes of longer characters are letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def held_out(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(column: pa.Array):
    """(first row, features, where each row's begin): the distinct hashed words and
    beginnings of words per text."""
    for at, raw, offsets in shingles.text_slices(column):
        low = shingles.lowered(raw)
        starts, ends = shingles.word_spans(low, offsets, _BETWEEN)
        n = len(offsets) - 1
        text = np.searchsorted(offsets, starts, "right") - 1
        hashes, texts = [shingles.hash_words(low, starts, ends)], [text]
        for size in BEGINNINGS:
            longer = np.flatnonzero(ends - starts > size)
            part = shingles.hash_words(low, starts[longer], starts[longer] + size)
            hashes.append(shingles.mix(part + np.uint64(size)))
            texts.append(text[longer])
        word = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
        both = np.unique((np.concatenate(texts) << BITS) | word)
        yield at, both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(n + 1))


@dataclass
class Model:
    weights: np.ndarray
    offset: float

    def scores(self, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
        held = np.concatenate([[0.0], np.cumsum(self.weights[words])])
        z = held[begin[1:]] - held[begin[:-1]] + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _texts_with(texts: list[np.ndarray]) -> np.ndarray:
    """How many texts hold each feature."""
    return np.bincount(np.concatenate(texts).astype(np.int64), minlength=1 << BITS)


def train(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float,
          steps: int = STEPS, pace: float = RATE, l2: float = L2) -> Model:
    """Non-negative risk minimised by Adam; the loss is the logistic loss."""
    size = 1 << BITS
    prior = min(max(prior, 1e-3), 0.999)
    if not toxic or not unlabelled:
        return Model(np.zeros(size), float(np.log(prior / (1 - prior))))
    texts = toxic + unlabelled
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    word = np.concatenate(texts).astype(np.int64)
    in_toxic = _texts_with(toxic)
    rate_u = _texts_with(unlabelled) / len(unlabelled)
    spread = np.sqrt((rate_u + 1 / len(unlabelled)) / len(toxic))
    telling = (in_toxic >= MIN_TEXTS) & (
        in_toxic / len(toxic) - rate_u > MIN_LIFT * spread)
    row, word = row[telling[word]], word[telling[word]]
    used, word = np.unique(word, return_inverse=True)
    positive = np.arange(len(texts)) < len(toxic)
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    n_p, n_u = len(toxic), len(unlabelled)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[word], len(texts)) + b
        s = _sigmoid(z)
        # Logistic loss: of z as toxic it is -log s, as clean it is -log(1 - s).
        as_clean = np.logaddexp(0, z)
        clean = as_clean[~positive].mean() - prior * as_clean[positive].mean()
        g = np.zeros(len(texts))
        if clean >= 0:
            g[positive] = -prior / n_p
            g[~positive] = s[~positive] / n_u
        else:  # step back from fitting the unlabelled text too well
            g[positive] = s[positive] * (prior / n_p)
            g[~positive] = -s[~positive] / n_u
        grad = np.append(np.bincount(word, g[row], len(used)) + l2 * w * (clean >= 0), g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    z = np.bincount(row, w[word], len(texts))[~positive]
    weights = np.zeros(size)
    weights[used] = w
    # A text without any telling word is never toxic, whatever the prior.
    raising = w[w > 0]
    least = raising.min() / 2 if len(raising) else np.log((1 - prior) / prior)
    return Model(weights, -float(max(np.quantile(z, 1 - prior), least, 1e-6)))


def _words_of(docs: DataFrame, text: str, among: np.ndarray | None = None) -> list[np.ndarray]:
    """Features of each text; with ``among`` (true or false per feature) those only."""
    packed = None if among is None else np.packbits(among)

    def run(batches):
        use = None if packed is None else np.unpackbits(packed).astype(bool)
        for batch in batches:
            out = []
            for _, words, begin in features(batch.column(0)):
                for a, b in zip(begin, begin[1:]):
                    own = words[a:b]
                    out.append((own if use is None else own[use[own]]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["w"])

    return [np.frombuffer(r["w"], "<i4") for r in
            docs.select(F.col(text).alias("t")).mapInArrow(run, "w binary").toLocalIterator()]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    """The model of the training folds."""
    train_rows = ~held_out(key) & F.col(key).isNotNull()
    known = labels.where(train_rows & F.col(label).isNotNull()).groupBy(key).agg(
        F.max(label).alias("_toxic"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.count_if(F.col("_toxic") == 1)).first()
    order = F.xxhash64(F.lit(11), key)
    positives = known.where("_toxic = 1").orderBy(order, key).limit(MAX_TOXIC).select(key)
    toxic = _words_of(docs.join(positives, key, "left_semi"), text)
    total = docs.count()
    share = min(1.0, MAX_UNLABELLED / max(total, 1))
    picked = F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))
    # Features that too few toxic texts hold are never used and stay with the tasks.
    among = _texts_with(toxic) >= MIN_TEXTS if toxic else np.zeros(1 << BITS, bool)
    unlabelled = _words_of(docs.where(train_rows & picked), text, among)
    return train(toxic, unlabelled, n_toxic / max(n, 1))


def score(docs: DataFrame, model: Model, text: str = "text",
          name: str = "score") -> DataFrame:
    """``docs`` with ``name``, a double from 0 to 1; the text is kept."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.offset))
    columns = [c for c in docs.columns if c != name]
    at = columns.index(text)
    schema = T.StructType([f for f in docs.schema.fields if f.name != name]
                          + [T.StructField(name, T.DoubleType())])

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            out = [own.scores(words, begin) for _, words, begin in features(batch.column(at))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(out or [np.zeros(0)]), pa.float64())],
                names=[*columns, name])

    return docs.select(*columns).mapInArrow(run, schema)

"""Near duplicates by word n-gram Jaccard, exactly, with token-combination prefixes.

Two texts link when ``den * |A & B| >= num * |A | B|`` of their shingle sets. Tokens
(40-bit shingle hashes) have one global order: counted tokens that are rare, then the
rest. A set of n tokens that links with another misses at most
``e = n - ceil(num * n / den)`` of its own there. A set with more than e rare tokens
indexes its first e + 1 of them, each alone; its partners share one of these. Any other
set indexes its rare tokens alone and extends its prefix to the whole set, where most
tokens are frequent: all tokens are dealt by hash to classes, and what a class holds is
indexed as one combination. Linked sets differ in at most
``d = (n + n') * (den - num) / (den + num)`` tokens and there are more than d classes,
so they agree on a class. A combination holds some six tokens: sets that share a passage
and little else seldom agree on one, while pairs of tokens of the passage would join all
of them. The number of classes follows from a range of sizes; each set is dealt for the
two ranges that its partners may lie in. Classes without tokens are indexed only by
sets so unevenly dealt that they could agree with a partner on these alone.

Equal sets are collapsed first. Members of an index entry are compared with its
smallest member; what these comparisons join needs no more of them, so groups of
thousands of near copies cost as many comparisons as they have members. Members that
are still apart are compared with further smallest members and at last pair by pair. A
parity sketch of each set (which of 512 hash classes hold an odd number of tokens)
bounds two sets' difference from below, so pairs that differ too much go before their
texts are read. Every other candidate is verified on the whole texts. Tables that only
finished steps have read are deleted on the way.

Counting covers a fixed quarter of the hash space over all texts; which tokens count as
frequent changes the work and never the result.

Rows with null or blank text, or with a null key, link with nothing. Rows equal in key
and text are one document; a repeated key with other texts is more than one.
"""

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolemill.llm import shingles
from rolemill.llm.components import components
from rolemill.llm.tables import drop, keep

TOKEN_BITS = 40
# The counted part of the hash space.
COUNTED = 1 << (TOKEN_BITS - 2)
# Tokens in more sets than this are frequent; at most so many are told to the workers.
FREQUENT = 4
MOST_FREQUENT = 1 << 20
# Index entries with more members than this get further rounds of smallest members.
SMALL = 32
ROUNDS = 2
# Smallest entries of a set by which a pair is told from its repetitions.
LOWEST = 16
PARITY = 512
SKETCH = [f"b{i}" for i in range(PARITY // 64)]


def errors(n: int, num: int, den: int) -> int:
    """Tokens a set of n may miss in one that it links with."""
    return n - -(-num * n // den)


def _pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(
        tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(data) -> np.ndarray:
    five = np.frombuffer(data, np.uint8).reshape(-1, 5)
    eight = np.zeros((len(five), 8), np.uint8)
    eight[:, :5] = five
    return eight.view("<u8")[:, 0]


def _index(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, k, n, f1, f2, tokens, classes, b0..): set size, set fingerprint, counted
    tokens, combinations, the parity sketch."""
    def run(batches):
        for batch in batches:
            n_out, f1, f2, out, classes, odd = [], [], [], [], [], []
            for _, raw, offsets in shingles.text_slices(batch.column(2)):
                hashes, begin = shingles.shingle_sets(raw, offsets, words)
                one, two = shingles.mix(hashes), shingles.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
                        for x in (one, two)]
                f1.append((sums[0][begin[1:]] - sums[0][begin[:-1]]).view(np.int64))
                f2.append((sums[1][begin[1:]] - sums[1][begin[:-1]]).view(np.int64))
                n_out.append(np.diff(begin))
                sets = len(begin) - 1
                place = np.repeat(np.arange(sets), np.diff(begin)) * PARITY + (
                    two & np.uint64(PARITY - 1)).astype(np.int64)
                count = np.bincount(place, minlength=sets * PARITY) & 1
                odd.append(np.packbits(count.astype(np.uint8)).view(np.int64)
                           .reshape(sets, len(SKETCH)))
                short = hashes >> np.uint64(64 - TOKEN_BITS)
                for x, y in zip(begin.tolist(), begin[1:].tolist()):
                    out.append(_pack(short[x:x + int(np.searchsorted(short[x:y], COUNTED))]))
                made, ends = combinations(short, begin, num, den)
                packed = _pack(made)
                classes += [packed[5 * x:5 * y] for x, y in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 *[pa.array(np.concatenate(x or [np.zeros(0, np.int64)]).astype(np.int64))
                   for x in (n_out, f1, f2)], pa.array(out, pa.binary()), pa.array(classes, pa.binary()),
                 *[pa.array(np.ascontiguousarray(np.concatenate(
                     odd or [np.zeros((0, len(SKETCH)), np.int64)])[:, i]))
                   for i in range(len(SKETCH))]],
                names=["doc_id", "k", "n", "f1", "f2", "tokens", "classes", *SKETCH])

    return docs.mapInArrow(run, "doc_id long, k long, n long, f1 long, f2 long, tokens binary, "
                           "classes binary, " + ", ".join(f"{b} long" for b in SKETCH))


def _frequent(sets: DataFrame) -> np.ndarray:
    """Counted tokens in more than FREQUENT sets, ascending; the most frequent ones."""
    def run(batches):
        for batch in batches:
            own = [_unpack(b.as_buffer()) for b in batch.column(0)]
            tokens = np.concatenate(own or [np.zeros(0, np.uint64)])
            token, count = np.unique(tokens[tokens < COUNTED], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.astype(np.int64)), pa.array(count.astype(np.int64))],
                names=["token", "c"])

    rows = (sets.select("tokens").mapInArrow(run, "token long, c long")
            .groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") > FREQUENT)
            .orderBy(F.desc("c"), "token").limit(MOST_FREQUENT).select("token").toArrow())
    return np.sort(rows.column(0).to_numpy()).astype(np.uint64)


def _differ(n: int, most: int, num: int, den: int) -> int:
    """Tokens in which a set of n may differ from a linked one of at most ``most``."""
    return (n + min(most, den * n // num)) * (den - num) // (den + num)


@lru_cache(maxsize=None)
def _edges(upto: int, num: int, den: int) -> tuple:
    """Where ranges of sizes begin. Linked sizes lie in one range or in neighbours."""
    edges = [1]
    while edges[-1] <= upto:
        edges.append(den * edges[-1] // num + 1)
    return tuple(edges)


@lru_cache(maxsize=1 << 16)
def deals(n: int, num: int, den: int) -> tuple:
    """(range, classes, tokens n may differ in) for the two deals of a set of n."""
    edges = _edges(1 << n.bit_length(), num, den)
    at = bisect_right(edges, n) - 1
    out = []
    for upper in (at, at + 1):
        most = (edges[upper + 1] if upper + 1 < len(edges) else den * edges[upper] // num + 1) - 1
        # A twentieth and two more than needed, as some classes stay without tokens.
        out.append((upper, _differ(most, most, num, den) * 21 // 20 + 3, _differ(n, most, num, den)))
    return tuple(out)


def combinations(tokens: np.ndarray, begin: np.ndarray, num: int, den: int):
    """(40-bit combinations, where each set's begin) of sets ``tokens[begin[i]:begin[i + 1]]``."""
    sizes = np.diff(begin)
    kept, owner = [], []
    known, which = np.unique(sizes, return_inverse=True)
    for deal in (0, 1):
        told = np.array([deals(int(n), num, den)[deal] if n else (0, 0, 0) for n in known],
                        np.int64).reshape(-1, 3)[which]
        first = np.concatenate([[0], np.cumsum(told[:, 1])])
        own = np.repeat(np.arange(len(sizes)), sizes)
        salt = shingles.mix(told[:, 0].astype(np.uint64) + np.uint64(1 << 32))
        label = shingles.mix(tokens ^ salt[own]) % told[own, 1].astype(np.uint64)
        place = first[own] + label.astype(np.int64)
        held = np.bincount(place, minlength=first[-1])
        total = np.zeros(first[-1], np.uint64)
        np.add.at(total, place, shingles.mix(tokens))
        of = np.repeat(np.arange(len(sizes)), told[:, 1])
        filled = np.bincount(of[held > 0], minlength=len(sizes))
        use = (held > 0) | (filled <= told[:, 2])[of]
        within = (np.arange(first[-1]) - first[of]).astype(np.uint64)
        made = shingles.mix(total ^ shingles.mix(within ^ salt[of]))[use]
        kept.append(made >> np.uint64(64 - TOKEN_BITS))
        owner.append(of[use])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(kept)[order],
            np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]))


def signatures(tokens: np.ndarray, n: int, frequent: np.ndarray, num: int, den: int, classes=None):
    """The 64-bit index entries of one set; see the module's text. Without ``classes``,
    its combinations, ``tokens`` must be the whole set."""
    if not n:
        return np.zeros(0, np.uint64)
    need = errors(n, num, den) + 1
    counted = np.unique(tokens[tokens < COUNTED])
    at = np.minimum(np.searchsorted(frequent, counted), max(len(frequent) - 1, 0))
    hot = frequent[at] == counted if len(frequent) else np.zeros(len(counted), bool)
    rare = shingles.mix(counted[~hot][:need])
    if len(rare) == need:
        return rare
    if classes is None:
        classes = combinations(tokens, np.array([0, len(tokens)]), num, den)[0]
    return np.unique(np.concatenate([rare, shingles.mix(classes + np.uint64(1 << TOKEN_BITS))]))


def _signed(sets: DataFrame, num: int, den: int) -> DataFrame:
    shared = sets.sparkSession.sparkContext.broadcast(_frequent(sets))

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).to_pylist()
            made = [signatures(_unpack(t.as_buffer()), n, shared.value, num, den, _unpack(c.as_buffer()))
                    for t, c, n in zip(batch.column(2), batch.column(3), sizes)]
            count = np.array([len(x) for x in made], np.int64)
            repeat = np.repeat(np.arange(len(made)), count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(made or [np.zeros(0, np.uint64)]).view(np.int64)),
                 batch.column(0).take(pa.array(repeat)),
                 batch.column(1).take(pa.array(repeat))], names=["sig", "id", "n"])

    return sets.select("id", "n", "tokens", "classes").mapInArrow(run, "sig long, id long, n long")


def _fits(a: str, b: str, num: int, den: int):
    return (F.least(a, b) * den >= F.greatest(a, b) * num)


def _near(left: str, right: str, size, num: int, den: int):
    """Whether sketches with these prefixes leave room for a link."""
    differ = sum((F.bit_count(F.col(left + b).bitwiseXOR(F.col(right + b))) for b in SKETCH),
                 F.lit(0))
    return differ * (den + num) <= size * (den - num)


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole texts link."""
    def run(batches):
        last, last_set = None, None
        for batch in batches:
            sets = {}
            for name in ("left", "right"):
                parts = []
                column = batch.column(batch.schema.names.index(name))
                if name == "left":  # rows of one left text follow each other
                    ids = batch.column(0).to_numpy()
                    fresh = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                    column = column.take(pa.array(fresh))
                for _, raw, offsets in shingles.text_slices(column):
                    hashes, begin = shingles.shingle_sets(raw, offsets, words)
                    parts += [hashes[x:y] for x, y in zip(begin, begin[1:])]
                sets[name] = parts
            which = np.cumsum(np.append(True, ids[1:] != ids[:-1])) - 1
            keep_rows = []
            for row, right in enumerate(sets["right"]):
                left = sets["left"][which[row]]
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep_rows.append(den * shared >= num * (len(left) + len(right) - shared))
            chosen = batch.filter(pa.array(keep_rows, pa.bool_()))
            yield pa.RecordBatch.from_arrays(chosen.columns[:2], names=["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    return (pairs.select("a", "b").join(right, "b").join(left, "a")
            .select("a", "b", "left", "right").mapInArrow(run, "a long, b long").distinct())


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5,
         num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, k, n_shingles, component_id, is_first) of every row of ``docs``.

    ``k`` is xxhash64 of the text; ``is_first`` marks the document with the smallest
    (key, k) of its component, and every row that links with nothing."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"),
                         F.xxhash64(text).alias("k"), F.col(text).alias("text"))
    index = keep(_index(source, words, num, den)
                 .withColumn("id", F.monotonically_increasing_id()))
    sets = (index.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2")
            .agg(F.min(F.struct("doc_id", "k", "id")).alias("r")))
    reps = keep(sets.select("n", "f1", "f2", "r.doc_id", "r.k", "r.id"))
    rep_sets = keep(index.select("id", "tokens", "classes", *SKETCH).join(reps.select("id", "n"), "id"))
    sketch = keep(rep_sets.drop("tokens", "classes"))
    sketches = {p: sketch.select(F.col("id").alias(p + "id"), F.col("n").alias(p + "n"), *[
        F.col(b).alias(p + b) for b in SKETCH]) for p in ("a_", "b_")}
    entry = Window.partitionBy("sig")
    entries = keep(
        _signed(rep_sets, num, den)
        .withColumn("members", F.count(F.lit(1)).over(entry))
        .withColumn("lead", F.min(F.struct("id", "n")).over(entry))
        .where("members > 1")
        .select("sig", "id", "n", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n")))
    # Tokens have done their work.
    rows = keep(index.select("doc_id", "k", "n", "f1", "f2"))
    drop(index, rep_sets)

    def check(pairs: DataFrame) -> DataFrame:
        """The pairs that link. Texts are read for the pairs that the sketches leave."""
        close = keep(possible(pairs))
        ids = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
        wanted = keep(ids.join(reps, "id").select("id", "doc_id", "k"))
        texts = keep(source.join(wanted, ["doc_id", "k"]).dropDuplicates(["id"]).select("id", "text"))
        found = keep(verified(close, texts, words, num, den))
        drop(close, wanted, texts)
        return found

    def possible(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(sketches["a_"], F.col("a") == F.col("a_id"))
                .join(sketches["b_"], F.col("b") == F.col("b_id")))
        return both.where(_near("a_", "b_", F.col("a_n") + F.col("b_n"), num, den)).select("a", "b")

    stars = entries.where((F.col("id") != F.col("lead")) & _fits("n", "lead_n", num, den)).select(
        F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    tested = keep(stars)
    edges = check(tested)
    comps = keep(components(edges))
    open_, last = entries.where("id <> lead").select("sig", "id", "n"), entries
    for step in range(ROUNDS + 1):
        labelled = open_.join(comps, "id", "left").select(
            "sig", "id", "n", F.coalesce("comp", "id").alias("comp"))
        spread = labelled.groupBy("sig").agg(
            F.count(F.lit(1)).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
            F.min(F.struct("id", "n", "comp")).alias("l")).where("c0 <> c1").select("sig", "m", "l")
        apart = keep(labelled.join(spread, "sig"))
        drop(last)
        last = apart
        if step < ROUNDS:
            hot = apart.where(F.col("m") > SMALL)
            pairs = hot.where((F.col("comp") != F.col("l.comp")) & _fits("n", "l.n", num, den)) \
                .select(F.col("l.id").alias("a"), F.col("id").alias("b"))
            open_ = apart.where((F.col("m") <= SMALL) | (F.col("id") != F.col("l.id"))).select(
                "sig", "id", "n")
        else:
            # Entries with the same members say the same; one of them is enough.
            alike = apart.groupBy("sig").agg(
                F.count(F.lit(1)).alias("m"), F.min("id").alias("i0"), F.max("id").alias("i1"),
                F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"))
            alone = alike.groupBy("m", "i0", "i1", "s").agg(F.min("sig").alias("sig"))
            rest = keep(apart.join(alone.select("sig"), "sig", "left_semi").select("sig", "id", "comp"))
            # Long sets share many entries; a pair is made in its first one, as far as the
            # lowest entries of both sets tell.
            place = F.row_number().over(Window.partitionBy("id").orderBy("sig"))
            low = keep(rest.withColumn("place", place).where(F.col("place") <= LOWEST)
                       .groupBy("id").agg(F.collect_list("sig").alias("low")))
            one, two = (rest.withColumnRenamed("comp", "comp" if p == "a_" else "b_comp")
                        .join(sketches[p], F.col("id") == F.col(p + "id"))
                        .join(low.withColumnRenamed("low", p + "low"), "id").drop("id")
                        for p in ("a_", "b_"))
            earlier = F.array_min(F.array_intersect("a_low", "b_low")) < F.col("sig")
            pairs = one.join(two, "sig").where(
                (F.col("a_id") < F.col("b_id")) & (F.col("comp") != F.col("b_comp"))
                & _fits("a_n", "b_n", num, den)
                & _near("a_", "b_", F.col("a_n") + F.col("b_n"), num, den)
                & ~F.coalesce(earlier, F.lit(False))).select(
                F.col("a_id").alias("a"), F.col("b_id").alias("b"))
        pairs = keep(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        found = check(pairs)
        tested = tested.unionByName(pairs)
        edges = edges.unionByName(found)
        comps = keep(components(edges))
    group = (reps.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    first = group.groupBy("comp").agg(F.min(F.struct("doc_id", "k")).alias("_first"))
    named = group.join(first, "comp").select("n", "f1", "f2", "_first")
    out = rows.join(named, ["n", "f1", "f2"], "left")
    linked = F.col("_first").isNotNull() & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", "k", F.col("n").alias("n_shingles"),
        F.when(linked, F.col("_first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, (F.col("doc_id") == F.col("_first.doc_id"))
               & (F.col("k") == F.col("_first.k"))).otherwise(True).alias("is_first"))

"""The trie of conversation prefixes, from sorted conversations and their LCPs.

A conversation is the sequence of its turns (role, text), ordered by turn number, null
numbers first, equal numbers by the turn's hash; a null role or text counts as empty.
Rebuilt conversations take their first turns from the head of their hundred, see
``rebuilt``. A turn travels as the 32 hex digits of its MD5, so that prefixes of a
conversation are prefixes of its string, and texts are read once only.

Conversations are sorted by range; equal ones collapse to one row while the sorted rows
stream by. The sorted distinct ones are dealt to blocks. Within a block a sparse table
of the LCPs of neighbours answers range minima, and each candidate prefix (conversation
i, depth d) finds by binary search on that table how far to the left and to the right the
conversations agree with i on d turns. Members, leaves, new children and saved tokens of
the interval are differences of running sums; the smallest member is one more range
minimum. Prefixes that reach over a block's border are pieces: the block that holds
their first conversation owns them, found by the same searches on a second sparse table,
that of the blocks' own minima (two numbers a block of ``BLOCK_ROWS`` conversations or
``BLOCK_BYTES`` bytes), and the owner sums up the pieces. So no node's members ever meet
in one task, however common a first turn or a whole conversation is; hashes of the ids
that end at a node are computed over a stream of sorted pieces of text.

Turns without a conversation id belong to none and are left out. An empty table has no
nodes. Memory of a task is one block; a conversation takes 36 bytes a turn in it, the
longest one included. Extra columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolemill.llm.tables import keep

BLOCK_ROWS = 50_000
BLOCK_BYTES = 32 << 20
# Ids of one conversation's copies are joined to texts of at most so many characters.
IDS_CHARS = 1 << 16
# Hex digits of a turn's hash.
TURN = 32
_FAR = np.iinfo(np.int64).max


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's array of (turn, hash, chars), in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return (turns.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
                F.col("turn").cast("long").alias("turn"), digest.alias("hash"),
                F.length(text).alias("chars")).alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def whole(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, chars) of the conversations as they are."""
    return _flat(sequences(turns), F.col("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, chars): the first h turns of the hundred's head, then the own turns
    after the first h, where h is crc32 of the id modulo 6."""
    own = sequences(turns)
    heads = own.where("conv_id % 100 = 0").select(
        F.col("conv_id").alias("head"), F.slice("turns", 1, 5).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    joined = own.withColumn("head", F.col("conv_id") - F.col("conv_id") % 100).join(
        heads, "head", "left").withColumn("h", h)
    none = F.array().cast("array<struct<turn:bigint,hash:string,chars:int>>")
    return _flat(joined, F.concat(
        F.coalesce(F.when(F.col("h") > 0, F.slice("lead", 1, F.greatest("h", F.lit(1)))), none),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))))


def _flat(df: DataFrame, turns) -> DataFrame:
    return df.withColumn("_t", turns).select(
        "conv_id", F.array_join(F.transform("_t", lambda t: t["hash"]), "").alias("seq"),
        F.transform("_t", lambda t: t["chars"]).alias("chars"))


def _runs(convs: DataFrame) -> DataFrame:
    """Equal conversations that follow each other in the sorted rows as one row: how
    many, the first id and all ids as text. A run may be cut at any place."""
    def run(batches):
        seq, chars, ids = None, None, []

        def made():
            return [seq, chars, len(ids), ids[0], ",".join(map(str, ids))]

        for batch in batches:
            out, columns = [], [c.to_pylist() for c in batch.columns]
            for c, s, t in zip(*columns):
                if ids and (s != seq or len(ids) * 12 >= IDS_CHARS):
                    out.append(made())
                    ids = []
                seq, chars = s, t
                ids.append(c)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(names, made()))], schema)

    names = ["seq", "chars", "n", "conv", "ids"]
    schema = pa.schema([("seq", pa.string()), ("chars", pa.list_(pa.int32())), ("n", pa.int64()),
                        ("conv", pa.int64()), ("ids", pa.string())])
    ordered = convs.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    return ordered.select("conv_id", "seq", "chars").mapInArrow(
        run, "seq string, chars array<int>, n long, conv long, ids string")


def _ends(runs: DataFrame) -> DataFrame:
    """(end_conv, ends_sha256) of each distinct conversation: hash of its sorted ids."""
    def run(batches):
        last, first, state = None, None, None
        for batch in batches:
            out = []
            for g, conv, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if g != last:
                    if state is not None:
                        out.append((first, state.hexdigest()))
                    last, first, state = g, conv, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _pairs(out)
        if state is not None:
            yield _pairs([(first, state.hexdigest())])

    def _pairs(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
            names=["end_conv", "ends_sha256"])

    grouped = runs.select(F.md5(F.col("seq").cast("binary")).alias("g"), "conv", "ids")
    return grouped.repartition("g").sortWithinPartitions("g", "conv").mapInArrow(
        run, "end_conv long, ends_sha256 string")


def _shared(one: str, two: str) -> int:
    """Turns that two conversations have in common at their beginning."""
    if two.startswith(one):
        return len(one) // TURN
    low, high = 0, min(len(one), len(two)) // TURN
    while low < high:  # the longest common prefix, by bisection
        mid = (low + high + 1) // 2
        low, high = (mid, high) if one[:mid * TURN] == two[:mid * TURN] else (low, mid - 1)
    return low


def _blocks(distinct: DataFrame) -> DataFrame:
    """The sorted rows with their block and the LCP with the row before, -1 at a block's
    first row."""
    from pyspark import TaskContext

    def run(batches):
        block, rows, size, last = TaskContext.get().partitionId() << 32, 0, 0, None
        for batch in batches:
            seqs, where, lcps = batch.column(0).to_pylist(), [], []
            for s in seqs:
                if rows >= BLOCK_ROWS or size + len(s) > BLOCK_BYTES and rows:
                    block, rows, size = block + 1, 0, 0
                lcps.append(_shared(last, s) if rows else -1)
                where.append(block)
                rows, size, last = rows + 1, size + len(s), s
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(where, pa.int64()), pa.array(lcps, pa.int64())],
                names=["seq", "chars", "n", "conv", "block", "lcp"])

    ordered = distinct.repartitionByRange("seq").sortWithinPartitions("seq")
    return ordered.select("seq", "chars", "n", "conv").mapInArrow(
        run, "seq string, chars array<int>, n long, conv long, block long, lcp long")


class RangeMin:
    """Minima of ranges, and searches for how far values stay at or above a bound."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (step := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def minimum(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Smallest of values[left..right], ends included."""
        level = np.frexp((right - left + 1).astype(float))[1] - 1
        out = np.empty(len(left), np.int64)
        for k in np.unique(level):
            at = level == k
            own = self.levels[k]
            out[at] = np.minimum(own[left[at]], own[right[at] - (1 << int(k)) + 1])
        return out

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to which all values after ``at`` are >= bound."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            own = self.levels[k]
            start = np.minimum(at + 1, len(own) - 1)
            fits = (at + 1 < len(own)) & (own[start] >= bound)
            at[fits] += 1 << k
        return at

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place down to which all values from it + 1 to ``at`` are >= bound."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            own, start = self.levels[k], at - (1 << k) + 1
            fits = (start >= 0) & (own[np.clip(start, 0, len(own) - 1)] >= bound)
            at[fits] -= 1 << k
        return at


class Borders:
    """How far a prefix reaches over blocks. ``over[k]``: turns that block k's first
    conversation shares with the last one before (-1: none before); ``inner[k]``: the
    smallest LCP within block k."""

    def __init__(self, ids: list, over: list, inner: list):
        self.place = {b: k for k, b in enumerate(ids)}
        self.over = np.array([*over, -1], np.int64)
        self.across = RangeMin(np.minimum(self.over[:-1], np.array(inner, np.int64)))

    def owner(self, k: int, depth: np.ndarray) -> np.ndarray:
        """The block that holds the first conversation with block k's first ``depth`` turns."""
        at = np.full(len(depth), k, np.int64)
        before = self.over[k] >= depth
        at[before] = self.across.left(at[before] - 1, depth[before])
        return at

    def last(self, k: int, depth: np.ndarray) -> np.ndarray:
        """The last block whose last conversation begins with block k's last ``depth`` turns."""
        return self.across.right(np.full(len(depth), k, np.int64), depth)


NODE = ("block long, owner long, depth long, open boolean, conv long, n long, children long, "
        "leaves long, saved long, chars long, upto long, end_conv long, parent_owner long, "
        "parent_conv long")


def _block_nodes(k: int, lcp, lengths, chars, n, conv, borders: Borders) -> dict:
    """The nodes and pieces of one block; see the module's text."""
    size = len(lcp)
    made = lengths - lcp
    base = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(size), made)
    depth = np.arange(base[-1]) - base[row] + lcp[row] + 1
    table, smallest = RangeMin(lcp), RangeMin(conv)
    left, right = table.left(row, depth), table.right(row, depth)
    before, after = borders.over[k], borders.over[k + 1]
    from_left = (left == 0) & (depth <= before)
    to_right = (right == size - 1) & (depth <= after)
    is_open = from_left | to_right
    owner = np.full(len(row), k, np.int64)
    owner[from_left] = borders.owner(k, depth[from_left])
    upto = np.full(len(row), k, np.int64)
    upto[to_right] = borders.last(k, depth[to_right])
    sums = np.concatenate([[0], np.cumsum(n)])
    members = sums[right + 1] - sums[left]
    first = smallest.minimum(left, right)
    leaf = np.append(lcp[1:], after) < lengths
    leaf_sums = np.concatenate([[0], np.cumsum(leaf)])
    start = np.concatenate([[0], np.cumsum(lengths)])
    own_chars = np.where(depth > 0, np.append(chars, 0)[start[row] + np.maximum(depth, 1) - 1], 0) \
        if len(chars) else np.zeros(len(row), np.int64)
    saved = np.where(is_open, 0, (members - 1) * own_chars)
    saved_sums = np.concatenate([[0], np.cumsum(saved)])
    inner = depth > 0
    up = table.left(row[inner], depth[inner] - 1)
    parent = np.full(len(row), -1, np.int64)
    parent[inner] = base[up] + depth[inner] - 1 - (lcp[up] + 1)
    born = inner & ~from_left
    has = parent >= 0
    at = np.maximum(parent, 0)
    return {
        "block": np.full(len(row), k, np.int64), "owner": owner, "depth": depth, "open": is_open,
        "conv": first, "n": members,
        "children": np.bincount(parent[born], minlength=len(row)),
        "leaves": leaf_sums[right + 1] - leaf_sums[left],
        "saved": saved_sums[base[right + 1]] - saved_sums[np.arange(len(row))],
        "chars": own_chars, "upto": upto,
        "end_conv": pa.array(conv[left], mask=(lengths[left] != depth) | (from_left & (owner != k))),
        "parent_owner": pa.array(owner[at], mask=~(has & is_open[at])),
        "parent_conv": pa.array(first[at], mask=~(has & ~is_open[at]))}


def _nodes(sorted_rows: DataFrame, borders: Borders) -> DataFrame:
    def run(table):
        table = table.sort_by("seq")
        lengths = np.array([len(s) // TURN for s in table.column("seq").to_pylist()], np.int64)
        chars = np.concatenate([np.zeros(0, np.int64), *(
            c.flatten().to_numpy() for c in table.column("chars").chunks)])
        k = borders.place[table.column("block")[0].as_py()]
        made = _block_nodes(k, *(table.column("lcp").to_numpy().copy(), lengths, chars.astype(np.int64),
                                 table.column("n").to_numpy(), table.column("conv").to_numpy()),
                            borders)
        return pa.table({name: pa.array(column) for name, column in made.items()})

    return sorted_rows.groupBy("block").applyInArrow(run, NODE)


def _borders(sorted_rows: DataFrame) -> Borders:
    """Two numbers a block; the conversations at the borders are compared by Spark."""
    blocks = sorted_rows.groupBy("block").agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"),
        F.coalesce(F.min(F.when(F.col("lcp") >= 0, F.col("lcp"))), F.lit(_FAR)).alias("inner"))
    before = F.lag("last").over(Window.orderBy("block"))

    def run(batches):
        for batch in batches:
            over = [-1 if b is None else _shared(b, a) for b, a in zip(
                batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(over, pa.int64())],
                                             names=["block", "inner", "over"])

    rows = (blocks.withColumn("before", before).select("block", "inner", "before", "first")
            .mapInArrow(run, "block long, inner long, over long").toArrow().sort_by("block"))
    return Borders(*(rows.column(c).to_pylist() for c in ("block", "over", "inner")))


def trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, seq, chars); see the module's text.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    runs = keep(_runs(convs))
    distinct = runs.groupBy("seq").agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.first("chars").alias("chars"))
    sorted_rows = keep(_blocks(distinct))
    nodes = keep(_nodes(sorted_rows, _borders(sorted_rows)))
    pieces = nodes.where("open")
    at_owner = F.col("block") == F.col("owner")
    whole = pieces.groupBy("owner", "depth").agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("closed_saved"),
        F.max("chars").alias("chars"), F.max("end_conv").alias("end_conv"),
        F.max(F.when(at_owner, F.col("upto"))).alias("upto"),
        F.max(F.when(at_owner, F.col("parent_owner"))).alias("parent_owner"))
    whole = keep(whole.withColumn("own", (F.col("n") - 1) * F.col("chars")))
    # Nodes over borders in the order (owner, depth): a subtree is one stretch of it.
    deeper = Window.partitionBy("owner").orderBy(F.desc("depth"))
    by_owner = whole.groupBy("owner").agg(F.sum("own").alias("total")).withColumn(
        "sum", F.sum("total").over(Window.orderBy("owner")))
    blocks = sorted_rows.select("block").distinct().withColumn(
        "place", F.row_number().over(Window.orderBy("block")).cast("long") - 1)
    upto = (blocks.join(by_owner, F.col("place") == F.col("owner"), "left")
            .select("place", F.coalesce(F.last("sum", True).over(Window.orderBy("place")), F.lit(0))
                    .cast("long").alias("sum")))
    over = keep(
        whole.withColumn("below", F.sum("own").over(deeper))
        .join(upto.select(F.col("place").alias("upto"), F.col("sum").alias("to_last")), "upto")
        .join(upto.select(F.col("place").alias("owner"), F.col("sum").alias("to_owner")), "owner")
        .withColumn("saved", F.col("closed_saved") + F.col("below") + F.col("to_last") - F.col("to_owner")))
    parents = over.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"),
                          F.col("conv").alias("open_parent"))
    crossing = over.join(parents, ["parent_owner", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("open_parent").alias("parent_conv_id"),
        "n", "children", "leaves", "saved", "end_conv")
    # A common parent's name comes to each block once, then to its children there.
    in_block = pieces.select("block", F.col("owner").alias("parent_owner"),
                             (F.col("depth") + 1).alias("depth")).join(parents, ["parent_owner", "depth"])
    closed = nodes.where("not open")

    def named(df: DataFrame, parent: str) -> DataFrame:
        return df.select(F.col("conv").alias("conv_id"), "depth", F.col(parent).alias("parent_conv_id"),
                         "n", "children", "leaves", "saved", "end_conv")

    every = crossing.unionByName(named(closed.where("parent_owner is null"), "parent_conv")).unionByName(
        named(closed.where("parent_owner is not null").join(
            in_block, ["block", "parent_owner", "depth"]), "open_parent"))
    none = F.sha2(F.lit("").cast("binary"), 256).alias("ends_sha256")
    hashed = (every.where("end_conv is not null").join(_ends(runs), "end_conv")
              .unionByName(every.where("end_conv is null").withColumn("ends_sha256", none)))
    return hashed.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"), "ends_sha256")

"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. A coordinate that makes all lengths equal turns the
largest inner product into the nearest neighbour. The graph starts from blocks of
vectors on the same side of random planes; blocks that are too large are cut by
planes of their own through their centre, other planes in every table, until they
fit. Then every round joins each node's neighbours with each other (neighbours of
neighbours), and all keep their nearest, until few edges change.
Queries start at the best of a bounded set of entry nodes and at the neighbours of
their own node, and, hop by hop, expand the best nodes not yet expanded along the
graph's edges in both directions. Up to there vectors travel as two bytes a component
with a factor each; what was found is scored again in double precision on the given
vectors.

Null, empty and zero vectors and those with null or non-finite components take no
part, nor do null ids. Vectors of different lengths have no inner product: those of
each length are searched among themselves. Of equal rows each is a candidate of its own. Ties go to the smaller id.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolemill.llm.tables import keep

DEGREE = 32
JOINED = 8
# Rounds end when a smaller share of the edges is new.
CHANGED = 0.01
TABLES = 12
BLOCK = 2048
BLOCK_TOP = 10
ENTRIES = 1024
POOL = 160
EXPANDED = 40
HOPS = 4
# Rows of a block compared at once, so that memory is bounded.
ROWS = 256


def _coded(v: np.ndarray) -> list[bytes]:
    """Each row as a factor (float32) and two signed bytes a component."""
    factor = np.maximum(np.abs(v).max(1), 1e-30).astype("<f4") / np.float32(32767)
    part = np.rint(v / factor[:, None]).astype("<i2")
    whole = np.concatenate([factor[:, None].view(np.uint8), part.view(np.uint8)], 1)
    return [row.tobytes() for row in whole]


def _matrix(column) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1), np.float32)
    whole = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    factor = np.ascontiguousarray(whole[:, :4]).view("<f4")
    return np.ascontiguousarray(whole[:, 4:]).view("<i2") * factor


def _groups(batches, key: str):
    """Tables that hold whole groups of equal ``key``, from rows sorted by it."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and len(rest):
            table = pa.concat_tables([rest, table])
        if not len(table):
            continue
        keys = table.column(key).to_numpy()
        last = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
        if last:
            yield table.slice(0, last).combine_chunks()
        rest = table.slice(last)
    if rest is not None and len(rest):
        yield rest.combine_chunks()


def _near_in_groups(rows: DataFrame, key: str, top: int) -> DataFrame:
    """(u, x, s): each node's ``top`` nearest in each group, if nearer than ``kth``."""
    def run(batches):
        for table in _groups(batches, key):
            keys = table.column(key).to_numpy()
            ids, kth = table.column("u").to_numpy(), table.column("kth").to_numpy()
            vec = _matrix(table.column("vec"))
            begin = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
            us, xs, ss = [], [], []
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                own, v, t = ids[a:b], vec[a:b], min(top, b - a)
                for c in range(0, b - a, ROWS):
                    s = v[c:c + ROWS] @ v.T
                    s[own[c:c + ROWS, None] == own[None, :]] = -np.inf
                    best = np.argpartition(s, b - a - t, 1)[:, b - a - t:]
                    value = np.take_along_axis(s, best, 1)
                    i, j = np.nonzero(value > kth[a + c:a + c + len(s), None])
                    us.append(own[c + i])
                    xs.append(own[best[i, j]])
                    ss.append(value[i, j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(us)), pa.array(np.concatenate(xs)),
                 pa.array(np.concatenate(ss).astype(np.float32))], names=["u", "x", "s"])

    n = max(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"), "1")
    return (rows.select(key, "u", "kth", "vec").repartition(int(n), key)
            .sortWithinPartitions(key).mapInArrow(run, "u long, x long, s float"))


def _nearest(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` edges of each node; ``new`` is 0 for those known before."""
    order = Window.partitionBy("u").orderBy(F.desc("s"), "x")
    return (found.repartition("u").groupBy("u", "x")
            .agg(F.max("s").alias("s"), F.min("new").alias("new"))
            .withColumn("k", F.row_number().over(order)).where(F.col("k") <= top))


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, h) of the rows that take part; h is equal for equal vectors."""
    v = F.col(vector).cast("array<double>")
    whole = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).cast("long").alias("id"), v.alias("v"))
    return keep(whole.where(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (
            F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn(
        "h", F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)))


def nodes_of(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, vec) of the distinct vectors of one length, and (node, id) of their rows."""
    # Scaled by the largest component, so that no square overflows.
    widest = members.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    node = members.groupBy("h").agg(F.min("id").alias("node"), F.first("v").alias("v")).select(
        "h", "node", F.transform("v", lambda x: x / F.lit(widest or 1.0)).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = node.agg(F.max(norm)).first()[0]
    extra = F.sqrt(F.greatest(F.lit(0.0), F.lit(longest or 0.0) - norm))
    nodes = node.select("node", "h", F.concat("v", F.array(extra)).alias("vec"))

    def pack(batches):
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
            rows = _coded(flat.reshape(len(b), -1)) if len(b) else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(rows, pa.binary())],
                names=["node", "h", "vec"])

    nodes = keep(nodes.mapInArrow(pack, "node long, h string, vec binary"))
    return nodes, members.join(nodes.select("h", "node"), "h").select("node", "id", "v")


def _cut(rows: DataFrame, hot: DataFrame, seed: int) -> DataFrame:
    """(u, code, before, vec): the rows of the codes in ``hot`` (code, c), each code cut
    by planes of its own through the mean of its members."""
    def sums(batches):
        total = {}
        for b in batches:
            codes, v = b.column(0).to_numpy(), _matrix(b.column(1)).astype(np.float64)
            for code in np.unique(codes).tolist():
                own = v[codes == code]
                n, t = total.get(code, (0, 0.0))
                total[code] = n + len(own), t + own.sum(0)
        for code, (n, t) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([code], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([t.tolist()], pa.list_(pa.float64()))], names=["code", "n", "t"])

    def cut(batches):
        for b in batches:
            codes, c = b.column(1).to_numpy(), b.column(2).to_numpy()
            v, sub = _matrix(b.column(3)), np.zeros(len(b), np.int64)
            each, first = np.unique(codes, return_index=True)
            for code, i in zip(each.tolist(), first.tolist()):
                own = np.flatnonzero(codes == code)
                bits = int(np.ceil(np.log2(c[i] / BLOCK)))
                planes = np.random.default_rng([seed, code % (1 << 64)]).standard_normal(
                    (bits, v.shape[1]))
                side = (v[own] - np.array(b.column(4)[i].as_py())) @ planes.T > 0
                sub[own] = (side * (1 << np.arange(bits))).sum(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sub), b.column(2), b.column(3)],
                names=["u", "code", "sub", "before", "vec"])

    own = rows.join(hot, "code")
    mean = (own.select("code", "vec").mapInArrow(sums, "code long, n long, t array<double>")
            .select("code", "n", F.posexplode("t").alias("i", "x"))
            .groupBy("code", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
            .groupBy("code").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
            .select("code", F.col("m.x").alias("mean")))
    return (own.join(keep(mean), "code").select("u", "code", "c", "vec", "mean")
            .mapInArrow(cut, "u long, code long, sub long, before long, vec binary")
            .select("u", F.xxhash64("code", "sub").alias("code"), "before", "vec"))


def blocks(rows: DataFrame, seed: int) -> DataFrame:
    """(w, u, vec): ``rows`` (u, code, vec) in blocks w of at most 2 * BLOCK."""
    rows, fit = rows.withColumn("before", F.lit(None).cast("long")), None
    while True:
        count = keep(rows.groupBy("code").agg(
            F.count(F.lit(1)).alias("c"), F.max("before").alias("_b")))
        # No plane divides vectors of equal bytes, which are all equally near here.
        done = (F.col("c") <= 2 * BLOCK) | F.coalesce(F.col("c") == F.col("_b"), F.lit(False))
        part = F.pmod(F.xxhash64(F.lit(seed), "code", "u"), F.ceil(F.col("c") / (2 * BLOCK)))
        ready = rows.join(count.where(done), "code").select(
            F.xxhash64("code", part).alias("w"), "u", "vec")
        fit = ready if fit is None else fit.unionByName(ready)
        hot = keep(count.where(~done).select("code", "c"))
        if hot.isEmpty():
            return fit
        rows = keep(_cut(rows.select("u", "code", "vec"), hot, seed))


def build(nodes: DataFrame, degree: int = DEGREE, rounds: int | None = None,
          tables: int = TABLES, seed: int = 5) -> DataFrame:
    """The graph (u, x, s, k): each node's ``degree`` nearest found. Rounds go on until
    few edges change, or ``rounds`` times."""
    total = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(total, 1) / BLOCK))))
    tables = tables if bits else 1  # without planes all tables are the same

    def coded(batches):
        for b in batches:
            v = _matrix(b.column(1))
            rng = np.random.default_rng(seed)
            planes = rng.standard_normal((tables, max(bits, 1), v.shape[1]))
            weights = 1 << np.arange(max(bits, 1))
            for t in range(tables):
                code = ((v @ planes[t].T > 0) * weights).sum(1) if bits else np.zeros(len(v), int)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(code.astype(np.int64) * tables + t), b.column(1)],
                    names=["u", "code", "vec"])

    rows = nodes.select("node", "vec").mapInArrow(coded, "u long, code long, vec binary")
    start = blocks(rows, seed).withColumn("kth", F.lit(float("-inf")).cast("float"))
    graph = keep(_nearest(
        _near_in_groups(start, "w", max(BLOCK_TOP, -(-degree // tables)))
        .withColumn("new", F.lit(1)), degree))
    done = 0
    while rounds is None or done < rounds:
        kth = graph.groupBy("u").agg(
            F.when(F.count(F.lit(1)) < degree, float("-inf")).otherwise(F.min("s"))
            .cast("float").alias("kth"))
        back = Window.partitionBy("x").orderBy(F.desc("s"), "u")
        ahead = graph.where(F.col("k") <= JOINED).select(F.col("u").alias("w"), F.col("x").alias("m"))
        behind = (graph.withColumn("r", F.row_number().over(back)).where(F.col("r") <= JOINED)
                  .select(F.col("x").alias("w"), F.col("u").alias("m")))
        own = graph.select(F.col("u").alias("w"), F.col("u").alias("m")).distinct()
        pairs = ahead.unionByName(behind).unionByName(own).distinct()
        vecs = nodes.select(F.col("node").alias("m"), "vec").join(
            kth.withColumnRenamed("u", "m"), "m", "left")
        local = pairs.join(vecs, "m").select(
            "w", F.col("m").alias("u"), F.coalesce("kth", F.lit(float("-inf")).cast("float"))
            .alias("kth"), "vec")
        better = _near_in_groups(local, "w", 8)
        graph = keep(_nearest(
            graph.select("u", "x", "s", F.lit(0).alias("new"))
            .unionByName(better.withColumn("new", F.lit(1))), degree))
        done += 1
        edges, new = graph.agg(F.count(F.lit(1)), F.sum("new")).first()
        if (new or 0) <= CHANGED * edges:
            break
    return graph


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, hops: int = HOPS,
           pool: int = POOL, expanded: int = EXPANDED, seed: int = 5) -> DataFrame:
    """(q, x) pools of the nodes found for ``queries`` (q, qv); a query that is a node
    starts at that node's neighbours too."""
    entry = nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(ENTRIES).select(
        "node", "vec").toArrow()
    shared = nodes.sparkSession.sparkContext.broadcast(
        (entry.column(0).to_numpy(), _matrix(entry.column(1))))

    def starts(batches):
        ids, v = shared.value
        for b in batches:
            if not len(b) or not len(ids):
                continue
            s = _matrix(b.column(1)) @ v.T
            t = min(expanded, len(ids))
            best = np.argpartition(-s, t - 1, 1)[:, :t]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(len(b)), t))),
                 pa.array(ids[best].ravel()),
                 pa.array(np.take_along_axis(s, best, 1).ravel().astype(np.float32))],
                names=["q", "x", "s"])

    def scored(batches):
        for b in batches:
            s = np.einsum("ij,ij->i", _matrix(b.column(1)), _matrix(b.column(3)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(s.astype(np.float32))], names=["q", "x", "s"])

    def with_scores(pairs: DataFrame) -> DataFrame:
        return (pairs.join(queries, "q").join(
            nodes.select(F.col("node").alias("x"), "vec"), "x").select("q", "qv", "x", "vec")
            .mapInArrow(scored, "q long, x long, s float"))

    links = graph.select(F.col("u").alias("x"), F.col("x").alias("y"))
    back = graph.where(F.col("k") <= JOINED).select(F.col("x"), F.col("u").alias("y"))
    adjacent = keep(links.unionByName(back).distinct())
    best = Window.partitionBy("q").orderBy(F.desc("s"), "x")
    ready = Window.partitionBy("q", "done").orderBy(F.desc("s"), "x")
    own = graph.join(queries.select(F.col("q").alias("u")), "u").select(F.col("u").alias("q"), "x")
    state = (queries.mapInArrow(starts, "q long, x long, s float")
             .unionByName(with_scores(own)).groupBy("q", "x").agg(F.max("s").alias("s"))
             .withColumn("done", F.lit(False)))
    for _ in range(hops):
        front = keep(state.withColumn("r", F.row_number().over(ready)).withColumn(
            "go", ~F.col("done") & (F.col("r") <= expanded)).drop("r"))
        new = (front.where("go").join(adjacent, "x").select("q", F.col("y").alias("x"), F.lit(0).alias("known"))
               .unionByName(front.select("q", "x", F.lit(1).alias("known")))
               .groupBy("q", "x").agg(F.max("known").alias("known")).where("known = 0"))
        state = (front.select("q", "x", "s", (F.col("done") | F.col("go")).alias("done"))
                 .unionByName(with_scores(new.select("q", "x")).withColumn("done", F.lit(False)))
                 .withColumn("r", F.row_number().over(best)).where(F.col("r") <= pool).drop("r"))
    return keep(state.select("q", "x"))


def neighbours(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
               every: int = 20, top: int = 20) -> DataFrame:
    """The ``top`` candidates of largest inner product found for each query; queries
    are the rows whose key is divisible by ``every``. Vectors of each length have their
    own graph."""
    whole = valid(vectors, key, vector)
    sizes = whole.groupBy(F.size("v").alias("n")).agg(
        F.count(F.lit(1)).alias("c"), F.max(F.col("id") % every == 0).alias("asked"))
    alike = [r["n"] for r in sizes.where("c > 1 and asked").orderBy("n").collect()]
    found = [_neighbours(whole.where(F.size("v") == n), every, top) for n in alike or [0]]
    return reduce(DataFrame.unionByName, found)


def _neighbours(whole: DataFrame, every: int, top: int) -> DataFrame:
    """``neighbours`` of valid vectors of one length."""
    nodes, members = nodes_of(whole)
    members = keep(members)
    graph = build(nodes)
    asked = members.where(F.col("id") % every == 0).select("node", "id", "v").distinct()
    distinct_q = asked.select("node").distinct().join(nodes, "node")

    def flat(batches):  # the added coordinate is the nodes' alone
        for b in batches:
            m = _matrix(b.column(1)).copy()
            m[:, -1] = 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(_coded(m) if len(m) else [], pa.binary())],
                names=["q", "qv"])

    queries = keep(distinct_q.select("node", "vec").mapInArrow(flat, "q long, qv binary"))
    pools = search(queries, nodes, graph)
    low = Window.partitionBy("node").orderBy("id")
    first = members.select("node", "id").withColumn("r", F.row_number().over(low)).where(
        F.col("r") <= top + 1)
    values = members.groupBy("node").agg(F.first("v").alias("v"))
    exact = F.aggregate(F.zip_with("a", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scores = (pools.join(values.select(F.col("node").alias("q"), F.col("v").alias("a")), "q")
              .join(values.select(F.col("node").alias("x"), "v"), "x")
              .select("q", "x", exact.alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(scores, "q")
            .join(first.select(F.col("node").alias("x"), F.col("id").alias("vec_id")), "x")
            .where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

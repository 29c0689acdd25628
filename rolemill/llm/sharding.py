"""Shards of even row counts by balanced label propagation.

Documents of equal text are linked. Each starts in a shard by hash; then, in rounds,
linked documents adopt the shard that most of their neighbours are in, as far as that
shard's quota allows. Groups too large for a part of a shard are split first, so one
text may hold any share of the rows. What is not linked fills the free places, so
that row counts differ by one at most.

Nulls link with nothing. Equal rows are separate rows: each gets its own place. Row
numbers come from counts per (shard, bucket), never from one window over a shard.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.llm.tables import keep

SHARDS = 40
ROUNDS = 4
# The largest linked part, as a share of a shard.
PART = 4
# Share of a shard that linked documents may take while they move.
FILL = 0.95
ROWS_PER_BUCKET = 20_000


def _share(seed: int, *columns: str) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def numbered(df: DataFrame, buckets: int, by: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Gapless numbers from 0 within ``by``, and the counts of ``by``.

    Rows are numbered within small hash buckets; the buckets' counts, few rows, give
    where each bucket begins."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64("_row", F.lit(name)), F.lit(buckets)))
    counts = df.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_row")
    ranked = (df.withColumn("_inner", F.row_number().over(inside) - 1)
              .join(starts.drop("_n"), [*by, "_bucket"])
              .withColumn(name, (F.col("_start") + F.col("_inner")).cast("long"))
              .drop("_bucket", "_start", "_inner"))
    return ranked, counts.groupBy(*by).agg(F.sum("_n").alias("_n"))


def propagate(parts: DataFrame, sizes: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(_part, shard, n): where the documents of each part are, after the rounds."""
    shards = len(sizes)
    state = parts
    for step in range(rounds):
        held = dict.fromkeys(range(shards), 0) | {
            r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("n")).collect()}
        best = state.groupBy("_part").agg(
            F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_spread"),
            F.max(F.struct("n", F.pmod(F.xxhash64("_part", "shard"), F.lit(1 << 20)),
                           "shard")).alias("_best"))
        movers = best.where("_spread > 1").select(
            "_part", F.col("_best.shard").alias("_to"),
            (F.col("_all") - F.col("_best.n")).alias("_gain"))
        asked = {r[0]: r[1] for r in
                 movers.groupBy("_to").agg(F.sum("_gain")).collect()}
        if not asked:
            break
        # A shard also loses what moves away; the next round sees that room.
        quota = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, float(
            min(1.0, max(0.0, FILL * sizes[s] - held[s]) / max(asked.get(s, 0), 1))))])
        going = movers.where(_share(step, "_part") < quota[F.col("_to")])
        state = keep(
            state.join(going.select("_part", "_to"), "_part", "left")
            .groupBy("_part", F.coalesce("_to", "shard").alias("shard"))
            .agg(F.sum("n").alias("n")))
    return state


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id",
          text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Every row's size, text checksum, shard and slot."""
    t = F.col(text)
    rows = keep(docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.sha2(t, 256).alias("_group")))
    total = rows.count()
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    largest = max(1, total // shards // PART)
    groups = rows.where("_group is not null").groupBy("_group").agg(
        F.count(F.lit(1)).alias("_n")).where("_n > 1")
    started = F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int")
    linked = keep(
        rows.select("_row", "_group").join(groups, "_group")
        .withColumn("_part", F.xxhash64("_group", F.pmod(
            F.xxhash64(F.lit(1), "_row"), F.ceil(F.col("_n") / largest))))
        .select("_row", "_part", started.alias("shard")))
    state = propagate(linked.groupBy("_part", "shard").agg(
        F.count(F.lit(1)).alias("n")), sizes, rounds)
    settled = state.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_spread"), F.first("shard").alias("_at")).where("_spread = 1")
    wanted = (linked.join(settled.select("_part", "_at"), "_part", "left")
              .select("_row", F.coalesce("_at", "shard").alias("shard")))
    buckets = total // (ROWS_PER_BUCKET * shards) + 16
    ranked, _ = numbered(wanted, buckets, ["shard"], "slot")
    limit = F.element_at(F.array(*map(F.lit, sizes)), F.col("shard") + 1)
    placed = keep(ranked.where(F.col("slot") < limit))
    taken = dict(placed.groupBy("shard").count().collect())
    free, ends = [], []
    for s in range(shards):
        free.append(sizes[s] - taken.get(s, 0))
        ends.append(sum(free))
    rest = rows.select("_row").join(placed.select("_row"), "_row", "left_anti")
    filled, _ = numbered(rest.withColumn("_all", F.lit(0)), buckets * shards, ["_all"], "_k")
    at = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("_k"))).cast("int")
    begin = [ends[s] - free[s] - taken.get(s, 0) for s in range(shards)]
    filled = filled.withColumn("shard", at).select("_row", "shard", (
        F.col("_k") - F.element_at(F.array(*map(F.lit, begin)), F.col("shard") + 1))
        .cast("long").alias("slot"))
    return rows.join(placed.select("_row", "shard", "slot").unionByName(filled), "_row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))

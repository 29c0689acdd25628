"""Inverted index with phrase search, Boolean combination and BM25."""

import unicodedata
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.functions import boolean
from rolemill.functions.stem import stem, stem_tokens

# --- fixed values: BM25 parameters ---
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
BUCKETS = 64


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from Unicode itself."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0])
             for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def tokens(text: Column) -> Column:
    """Lower-cased, accent-folded runs of letters and digits."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), _FROM, _TO)
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(leaf: str, stemmed: bool) -> list[str]:
    folded = leaf.lower().translate(str.maketrans(_FROM, _TO))
    words = "".join(ch if unicodedata.category(ch)[0] in "LN" else " "
                    for ch in folded).split()
    return [stem(w) for w in words] if stemmed else words


@dataclass
class TextIndex:
    """``rows``: (term, job_id, field, pos, doc_len); ``stats``: one row."""

    rows: DataFrame
    stats: DataFrame
    stemmed: bool = True


def build(docs: DataFrame, fields=("title", "description_text", "company_name_raw"),
          key: str = "job_id", stemmed: bool = True) -> TextIndex:
    """Index the given text fields. Row-local: one output row per token."""
    per_doc = docs.select(F.col(key).alias("job_id"),
                          *[tokens(F.col(f)).alias(f"t{i}")
                            for i, f in enumerate(fields)])
    if stemmed:
        per_doc = per_doc.withColumns(
            {f"t{i}": stem_tokens(f"t{i}") for i in range(len(fields))})
    length = sum((F.size(f"t{i}") for i in range(1, len(fields))), F.size("t0"))
    per_doc = per_doc.withColumn("doc_len", length)

    def placed(i):
        return F.transform(f"t{i}", lambda t, p: F.struct(
            t.alias("term"), F.lit(i).alias("field"), p.alias("pos")))

    cells = F.flatten(F.array(*[placed(i) for i in range(len(fields))]))
    rows = per_doc.select("job_id", "doc_len", F.explode(cells).alias("x")).select(
        "x.term", "job_id", "x.field", "x.pos", "doc_len")
    stats = per_doc.agg(F.count(F.lit(1)).alias("n_docs"),
                        F.avg("doc_len").alias("avg_len"))
    return TextIndex(rows, stats, stemmed)


def save(index: TextIndex, path: str) -> None:
    """Write the index laid out by term, so a query reads a few buckets.

    A frequent term is spread over several writers by a salt on the document.
    """
    rows = index.rows.withColumn("bucket", F.crc32(F.encode("term", "utf-8")) % BUCKETS)
    (rows.repartition("bucket", F.pmod(F.xxhash64("job_id"), F.lit(16)))
     .sortWithinPartitions("bucket", "term")
     .write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/rows"))
    index.stats.write.mode("errorifexists").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str, stemmed: bool = True) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/rows"),
                     spark.read.parquet(f"{path}/stats"), stemmed)


def _combine(tree, matched: dict) -> Column | None:
    """Tree to one Boolean Column; leaves without tokens drop out."""
    if isinstance(tree, str):
        return matched.get(tree)
    op, left, right = tree[0], _combine(tree[1], matched), _combine(tree[2], matched)
    if left is None or right is None:
        return right if left is None else left
    return {"AND": left & right, "OR": left | right, "NOT": left & ~right}[op]


def leaf_frequencies(index: TextIndex, phrases: list[list[str]]) -> DataFrame:
    """One row per document with any phrase: ``tf0, tf1, …`` and ``doc_len``.

    An index row votes for the phrase starts it can belong to; a start with as
    many votes as the phrase has words is an occurrence. Everything after the
    single shuffle on the document reuses its partitioning.
    """
    places = {}
    for i, words in enumerate(phrases):
        for offset, word in enumerate(words):
            places.setdefault(word, []).append((i, offset))
    rows = index.rows
    if "bucket" in rows.columns:
        rows = rows.where(F.col("bucket").isin(
            sorted({zlib.crc32(w.encode()) % BUCKETS for w in places})))
    votes = F.create_map(*[c for word, spots in places.items() for c in (
        F.lit(word), F.array(*[F.struct(F.lit(i).alias("leaf"), F.lit(o).alias("offset"))
                               for i, o in spots]))])
    size = F.element_at(F.array(*[F.lit(len(w)) for w in phrases]), F.col("leaf") + 1)
    starts = (rows.where(F.col("term").isin(list(places)))
              .repartition("job_id")
              .select("job_id", "doc_len", "field", "pos",
                      F.explode(F.element_at(votes, F.col("term"))).alias("v"))
              .groupBy("job_id", "doc_len", F.col("v.leaf").alias("leaf"), "field",
                       (F.col("pos") - F.col("v.offset")).alias("start"))
              .agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") == size))
    return starts.groupBy("job_id", "doc_len").agg(
        *[F.count_if(F.col("leaf") == i).alias(f"tf{i}") for i in range(len(phrases))])


def match(index: TextIndex, expression: str) -> DataFrame:
    """(job_id, rank) of matching documents; a smaller rank is a better match."""
    tree = boolean.read(expression)
    phrases, names = [], {}
    for leaf in dict.fromkeys(boolean.leaves(tree) if tree else []):
        words = query_tokens(leaf, index.stemmed)
        if words:
            names[leaf] = len(phrases)
            phrases.append(words)
    if not phrases:
        return index.rows.select("job_id", F.lit(0.0).alias("rank")).where(F.lit(False))
    found = leaf_frequencies(index, phrases)
    keep = _combine(tree, {leaf: F.col(f"tf{i}") > 0 for leaf, i in names.items()})

    spread = found.agg(F.struct(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}")
                                  for i in range(len(phrases))]).alias("n")).scalar()
    n_docs = index.stats.select("n_docs").scalar()
    avg_len = index.stats.select("avg_len").scalar()
    scored = found.where(keep).withColumns(
        {"_n": spread, "_docs": n_docs, "_avg": avg_len})
    rank = F.lit(0.0)
    for i in range(len(phrases)):
        n, tf = F.col(f"_n.n{i}"), F.col(f"tf{i}")
        idf = F.ln((F.col("_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
        norm = K1 * (1 - B + B * F.col("doc_len") / F.col("_avg"))
        rank = rank - idf * tf * (K1 + 1) / (tf + norm)
    return scored.select("job_id", rank.alias("rank"))

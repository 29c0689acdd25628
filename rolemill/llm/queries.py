"""The operators over their whole tables, and the SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.llm import (
    bpe, chat, license_scan, line_dedup, ngram_join, nn_descent, packing, pii, prefix_trie, quality,
    sharding, token_align, toxicity)
from rolemill.llm.tables import read


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return ngram_join.link(docs, words=4, num=85).select(
        "doc_id", "n_shingles", "component_id")


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(read(spark, folder, "documents")).select(
        "doc_id", "n_found", "text")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_removed", "text")


def op4_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return nn_descent.neighbours(read(spark, folder, "embeddings"))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs))
    return out.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(read(spark, folder, "documents"))


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Spans as text, ``from-to`` with commas between."""
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(
        "-", m["from"].cast("string"), m["to"].cast("string"))), ",")
    return chat.rotate(read(spark, folder, "conversations")).withColumn("masks", spans)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    order = quality.ordered(docs, quality.rules())
    failed = (F.col("n_words") < 50) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality.cascade(quality.base(docs), order).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"))


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(read(spark, folder, "documents")).select(
        "doc_id", "n_words", F.col("n_places").alias("n_base"), "first_word", "last_word",
        F.col("phrase_labels").alias("base_labels"), "labels", "score")


def op12_token_align(spark: SparkSession, folder: str) -> DataFrame:
    return token_align.align(read(spark, folder, "documents"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(read(spark, folder, "conversations")))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_nn_descent": op4_nn_descent,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_chat": op8_chat,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_license_scan": op11_license_scan,
    "op12_token_align": op12_token_align,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL = {"op3_line_dedup": line_dedup.SQL, "op8_chat": chat.SQL}

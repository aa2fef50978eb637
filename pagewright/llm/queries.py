"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import (
    chat, log_bilinear, ngram_join, periodic, pieces, prefix_trie, quality, reference_sql, rules_forest, sharding, tiling, toxicity, url_filter,
    vector_graph)

#: Vocabulary file of the queries; operators take a path
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_read(spark, sf_dir, "pages"))
    return judged.withColumn("difference", F.round("difference", 6))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _read(spark, sf_dir, "labels")))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"), pieces.Vocabulary.load(PIECES))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(_read(spark, sf_dir, "documents"))


def op6_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.nearest(_read(spark, sf_dir, "embeddings"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = chat.linked_conversations(_read(spark, sf_dir, "conversations"), copies=True)
    return events.withColumn("errors", F.array_join("errors", "; "))


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, _read(spark, sf_dir, "labels")))


def op10_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_rules_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules_forest.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round(F.array_max("scores"), 6).alias("anomaly"))


def looped(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten repeats from some word on.

    With h the checksum of the id and g = h DIV 10, documents with h % 10 = 0 repeat, from word
    a = g % n on, the next 1 + (n - a) DIV (3 + g % 8) words.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", F.coalesce(h % 10 == 0, F.lit(False)).alias("chosen"), F.expr("crc32(CAST(doc_id AS string)) DIV 10").alias("g"))
    split = chosen.withColumn("w", F.when(F.col("chosen"), words)).withColumn("n", F.size("w"))
    placed = split.withColumn("a", F.expr("IF(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    loop = "array_join(transform(sequence(0L, n - 1L), i -> w[int(IF(i < a, i, a + (i - a) % p))]), ' ')"
    return placed.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {loop} ELSE text END").alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(looped(_read(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("(1000 * strongest.length) DIV strongest.period").alias("exponent_milli"),
        F.expr("sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.rebuilt_trie(_read(spark, sf_dir, "conversations"))
    return nodes.withColumn("ends_sha256", F.lower(F.hex("ends_digest"))).drop("ends_digest")


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_url_filter, op3_toxicity, op4_pieces, op5_ngram_join, op6_vector_graph, op7_chat, op8_log_bilinear, op9_quality, op10_tiling,
    op11_rules_forest, op12_periodic, op13_prefix_trie)}
ORACLE = dict(reference_sql.ORACLE)

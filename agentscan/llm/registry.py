"""Queries over the training-text tables, by number, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from agentscan.llm import archives, contamination, fingerprints, jaccard, language, licences, mixing, negatives, neighbours, oracles, pages, sharding, spelling, tokens
from agentscan.llm.common import prepare, read


def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = contamination.decontaminate(docs, items, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op2_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return archives.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, keep=["doc_id"])
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")  # of each time that it is taken
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(read(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs), keep=["doc_id"])
    return found.select("doc_id", (language.fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return tokens.token_counts(read(spark, sf_dir, "documents"), tokens.vocabulary_path(), keep=["doc_id"])


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pages.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.jaccard_join(read(spark, sf_dir, "documents")).select("doc_id", "copy_class", "class_id", "n_links")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fingerprints.edited_neighbours(read(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_contamination, op2_archives, op3_neighbours, op4_mixing, op5_licences, op6_sharding, op7_language, op8_tokens, op9_pages, op10_jaccard, op11_spelling, op12_fingerprints, op13_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    """The others draw, hash, train or search approximately; tests hold them against brute force."""
    return {"op1_contamination": oracles.OP1, "op2_archives": oracles.OP2, "op10_jaccard": oracles.OP10, "op11_spelling": oracles.OP11, "op12_fingerprints": oracles.OP12, "op13_negatives": oracles.OP13}

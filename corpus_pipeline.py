"""A corpus from raw documents to shards: language, near duplicates, contamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of ``documents``; the last adds each row's shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentscan.llm import contamination, jaccard, language, mixing, sharding
from agentscan.llm.common import prepare, read, written


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as one column, beside those that an operator reads: no name can clash with what it adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc__"), *columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages: not ``und``, and more probably in it than in all others together.

    A document without a language gets the predicted one. Null, empty and letterless texts are rejected,
    repeated rows alike and each for itself; any length of text is read whole. Without labels nothing
    can be told, and everything is rejected. An empty table stays empty; all columns are kept.
    """
    prepare(spark)
    net = language.train(docs)
    judged = language.identify(_packed(docs, "text"), net, keep=["__doc__"]).where((F.col("lang_pred") != "und") & (F.col("score") >= language.FLOOR))
    return judged.select(*[F.coalesce("__doc__.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"__doc__.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id, and one row of it.

    Rows of one doc_id with different texts are different documents and stay, each once; of repeated
    rows one stays. Null and wordless texts have no duplicates and stay, every row. A null doc_id stays
    where its group has no other. An empty table stays empty; all columns are kept.
    """
    prepare(spark)
    joined = jaccard.jaccard_join(_packed(docs, "doc_id", "text"))
    kept = joined.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "text_hash").agg(F.max(F.col("n_links") > 0).alias("linked"))
    kept = written(kept.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "linked"), "kept")
    rows = _packed(docs, "doc_id", F.xxhash64("text").alias("hash")).join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")))
    # repeated rows link to each other; of those, one stays
    first = rows.where("linked").groupBy("doc_id", "hash").agg(F.min_by("__doc__", F.xxhash64(F.to_json("__doc__"))).alias("__doc__"))
    return rows.where("not linked").select("__doc__.*").unionByName(first.select("__doc__.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in windows of benchmark items, without those words.

    What windows cover is cut from the texts that stay, and n_chars follows. Null and empty texts have
    no words and stay, as do repeated rows, each for itself. No benchmark items, or an empty table,
    change nothing; all columns are kept.
    """
    prepare(spark)
    found = contamination.decontaminate(_packed(docs, "text"), read(spark, sf_dir, "benchmark"), keep=["__doc__"])
    left = found.where(~contamination.contaminated(F.col("n_hit"), F.col("n_words")))
    text = contamination.without_spans(F.col("__doc__.text"), F.col("spans"))
    out = left.select("__doc__", "spans", text.alias("__cut__"))
    changed = {"text": F.col("__cut__")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("__cut__").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__doc__.n_chars"))
    return out.select(*[changed.get(c, F.col(f"__doc__.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of whole documents: a row for each time that one is drawn, shard by shard in shuffled order.

    A null source is a source of its own. Null and empty texts have no size and follow their blocks;
    repeated rows are drawn alike. An empty table stays empty; all columns are kept.
    """
    prepare(spark)
    mixed = mixing.mix(_packed(docs, "doc_id", "text", "source"), cut_last=False, keep=["__doc__"])
    return mixing.drawn(mixed.select("__doc__", "draws")).select("__doc__.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, and the shard it would have with one more.

    Rows of one doc_id, or of a null one, share a shard. A null text has size 1. An empty table stays
    empty; columns of the added names (size, text_crc32, law, shard, grown_shard) are replaced.
    """
    return sharding.place(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: The network's predictions and the tree's draws can't be written in SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs

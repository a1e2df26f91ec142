"""Weighted rendezvous sharding of records by a stable key, with gapless slots in each shard."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentscan.llm.common import written

#: Ranges of the key's hash in each shard within which slots are counted, at least; there are as many
#: as shuffle partitions if these are more.
RANGES = 256


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard with the highest score ``-weight / ln(u)``, where u in (0, 1) is a hash of key and shard.

    A shard's scores don't depend on the others, so one more shard takes rows only into itself and
    gets its weight's share of them. Equal scores go to the larger shard. A null key is a key too, and
    keys are hashed as text, so that a number's type doesn't matter.
    """
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def score(x: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), x["shard"], F.lit("rendezvous")), 11)
        return F.struct((-x["weight"] / F.log((bits.cast("double") + 0.5) * F.lit(math.ldexp(1, -53)))).alias("score"), x["shard"].alias("shard"))

    return F.array_max(F.transform(shards, score))["shard"]


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard and grown_shard; no shuffle, all other columns kept.

    A null text counts as empty: size 1, checksum 0. Columns of these names are replaced.
    """
    weights = weights or [1.0] * 16
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumns(
        {
            "size": F.octet_length(body).cast("long") + 1,
            "text_crc32": F.crc32(body),
            "law": F.lit("key"),
            "shard": rendezvous_shard(F.col(f"`{key}`"), weights),
            "grown_shard": rendezvous_shard(F.col(f"`{key}`"), [*weights, sum(weights) / len(weights)]),
        }
    )


def slotted(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per record: key, size, text_crc32, law, shard, slot, grown_shard.

    Slots count from 0 in each shard without gaps. Records that agree in key, size and checksum are
    counted before they are shuffled, so one frequent key is one row there. A shard's slots run through
    ranges of the key's hash; the ranges' first slots come from one small table of counts.
    """
    cols = [key, "size", "text_crc32", "law", "shard", "grown_shard"]
    ranges = max(RANGES, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("slot")), F.lit(ranges)).cast("int")
    equal = written(placed.select(*[F.col(f"`{c}`") for c in cols]).groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count("*").alias("n")).withColumn("range", part), "slots")
    counts = equal.groupBy("shard", "range").agg(F.sum("n").alias("rows"))
    running = F.sum("rows").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("shard", "range", running.alias("base"))
    w = Window.partitionBy("shard", "range").orderBy(F.col(f"`{key}`").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = equal.withColumn("ahead", F.coalesce(F.sum("n").over(w), F.lit(0)))
    first = F.coalesce(F.col("base"), F.lit(0)) + F.col("ahead")
    return inside.join(F.broadcast(before), ["shard", "range"], "left").select(  # at most a row for each shard and range
        F.col(f"`{key}`"),
        "size",
        "text_crc32",
        "law",
        "shard",
        F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"),
        "grown_shard",
    )


def shard_records(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """Every record's shard, slot and the shard it has once there is one more.

    Empty table: no rows. Repeated rows get slots of their own. Only the key and three numbers of each
    record are shuffled, never the text.
    """
    return slotted(place(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text, weights), key)

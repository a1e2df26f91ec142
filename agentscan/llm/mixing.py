"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks, about the square root of their number, so that neither a
source's blocks nor a block's documents are many. A source's target gives its exact quota of block
draws: whole passes over all blocks, then a random part of them, then one block of which only part is
taken. The quotas of all sources are split among the output shards by recursive multivariate
hypergeometric draws, as if all draws had been shuffled and cut into equal shards; each source's
permuted blocks go to the shards in disjoint runs of those lengths, and the documents of a shard are
shuffled within it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentscan.llm.common import written

#: Weights of the sources in order of their names; they repeat.
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a part of all words.
RATIO = 1.5
#: Times that a source, and a document, is taken at most.
REPEATS = 2
SHARDS = 16
#: Groups of sources between which the driver splits; each group is split among its sources in a task.
GROUPS = 64


def words_of(text: Column) -> Column:
    """Runs of characters other than white space (blank, tab to carriage return)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def split_tree(quotas: np.ndarray, room: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Splits exact quotas of draws among places with given room (equal sums): one row for each quota.

    Halves the places again and again; each time the draws of the first half are a multivariate
    hypergeometric sample of what is left to place.
    """
    if len(room) == 1:
        return quotas[:, None]
    half = len(room) // 2
    left = rng.multivariate_hypergeometric(quotas, int(room[:half].sum()), method="marginals") if quotas.sum() else quotas
    return np.concatenate([split_tree(left, room[:half], rng), split_tree(quotas - left, room[half:], rng)], axis=1)


def targets(sources: DataFrame, weights=WEIGHTS, ratio: float = RATIO, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with target.

    Sources in order of code points, null last, have the weights in turn and share ``ratio`` of all
    words; a target stops at ``repeats`` times its source's size, and what is over is shared again by
    weight among the others until no target is above. One row per source is all that is moved. Sources
    are sorted by ranges, whose sizes give each source its place, so any number of them will do.
    """
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    ranged = written(sources.repartitionByRange(parts, order).sortWithinPartitions(order).withColumns({"p": F.spark_partition_id(), "i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranged")
    base, total = {}, 0
    for r in ranged.groupBy("p").count().orderBy("p").collect():  # one row for each range
        base[r["p"]] = total
        total += r["count"]
    rank = F.col("i") + (F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("p")) if base else F.lit(0))
    weighed = written(ranged.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))).withColumn("most", (F.col("source_size") * repeats).cast("double")).drop("p", "i"), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight; it rises until the open sources take all that is left
    while True:
        shut = F.col("most") <= F.lit(level) * F.col("weight")
        x = weighed.agg(F.sum(F.when(shut, F.col("most"))).alias("full"), F.sum(F.when(~shut, F.col("weight"))).alias("open")).first()
        if not x["open"]:
            break
        new = (total * ratio - (x["full"] or 0.0)) / x["open"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return weighed.withColumn("target", F.least("most", F.lit(level) * F.col("weight"))).drop("most")


def drawn(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each draw of ``mix``'s result, with shard and position, shard by shard in shuffled order.

    Rows of a shard are brought together in tasks of even size, a large shard or a document that is
    repeated very often in several, and are sorted by position there.
    """
    rows = mixed.select(*[F.col(f"`{c}`") for c in mixed.columns if c not in ("draws", "shard", "position")], F.explode("draws").alias("__draw__"))
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "__draw__"], F.col("__draw__.shard").alias("shard"), F.col("__draw__.position").alias("position"))
    return rows.hint("rebalance", "shard").sortWithinPartitions("shard", "position")


def _fill(seed: int, cut_last: bool):
    """Takes documents of one block, in permuted order, as long as they fit what is left of the quota."""

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        left = int(block["rest"].iloc[0])
        b = block[["h", "size"]].assign(n=1).groupby(["h", "size"], as_index=False)["n"].sum().sort_values(["h", "size"])
        took: dict[int, int] = {}
        over = None
        for h, size, n in b.itertuples(index=False):
            if 0 < size * n <= left:
                took[h] = size
                left -= size * n
            elif size and n == 1 and over is None:
                over = (h, size)
        if over and left > 0 and (cut_last or 2 * left >= over[1]):
            took[over[0]] = min(left, over[1]) if cut_last else over[1]
        return pd.DataFrame({"source_key": [block["source_key"].iloc[0]], "block": [block["block"].iloc[0]], "hs": [list(took)], "ws": [list(took.values())]})

    return fill


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, ratio: float = RATIO, repeats: int = REPEATS, shards: int = SHARDS, cut_last: bool = True, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (all, if None) with size, source_size, target, taken and draws.

    draws: one struct for each time that the mix takes the document: its output shard, a position
    key within that shard, and the words taken, all of them but for the last document that a source's
    quota reaches. With ``cut_last`` that document gives its first words only, so that the source's
    words meet the target rounded; without, documents are taken whole and the source's words come
    within half a document of it, or as near as whole documents allow.

    A null text has no words and isn't drawn into a partial block. A null source is a source of its
    own. Repeated rows of a document are taken alike. No rows, no mix. Columns of ``docs`` with the
    added names are replaced. The result depends on the rows, not on their order or partitions.
    """
    added = ["size", "source_size", "target", "taken", "draws"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    size = words_of(F.col(f"`{text}`")).alias("size")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row__"), size, F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("null")).alias("source_key"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{key}`").alias("__key__")).select("__row__", "size", "source_key", "source", F.xxhash64("__key__", "size", F.lit(seed)).alias("h"))

    light = written(rows.select("source_key", "source", "size", "h"), "mix-sizes")
    per_source = written(light.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-sources")
    plan = written(
        targets(per_source, weights, ratio, repeats)
        .withColumn("n_blocks", F.ceil(F.sqrt("rows")))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0))
        .withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size"))),
        "mix-plan",
    )

    def block(n: Column) -> Column:
        return F.pmod(F.xxhash64("h", F.lit("block")), n)

    def with_block(df: DataFrame) -> DataFrame:
        return df.join(plan.select("source_key", "n_blocks", "passes", "rest", "source_size", "target"), "source_key").withColumn("block", block(F.col("n_blocks")))

    order = Window.partitionBy("source_key").orderBy(F.xxhash64("source_key", "block", F.lit(seed)), "block")
    blocks = written(
        with_block(light)
        .groupBy("source_key", "block")
        .agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
        .withColumn("ends", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rest", F.col("rest") - (F.col("ends") - F.col("words")))
        .withColumn("more", F.when((F.col("rest") <= 0) | (F.col("words") == 0), "none").when(F.col("words") <= F.col("rest"), "all").otherwise("part")),
        "mix-blocks",
    )
    partial = (
        with_block(light)
        .drop("rest")
        .join(blocks.where("more = 'part'").select("source_key", "block", "rest"), ["source_key", "block"])
        .groupBy("source_key", "block")
        .applyInPandas(_fill(seed, cut_last), "source_key string, block long, hs array<long>, ws array<long>")  # a block has about the root of its source's rows
    )

    quota = (F.col("passes") + F.when(F.col("more") != "none", 1).otherwise(0)).cast("long")
    quotas = written(blocks.groupBy("source_key").agg(F.sum(quota).alias("quota")).withColumn("group", F.pmod(F.xxhash64("source_key"), F.lit(GROUPS))), "mix-quotas")
    sums = {r["group"]: int(r["quota"]) for r in quotas.groupBy("group").agg(F.sum("quota").alias("quota")).collect()}  # GROUPS rows at most
    names = sorted(sums)
    total = sum(sums.values())
    room = np.array([total * (i + 1) // shards - total * i // shards for i in range(shards)], np.int64)
    by_group = dict(zip(names, split_tree(np.array([sums[g] for g in names], np.int64), room, np.random.default_rng(seed)), strict=True)) if names else {}

    def split_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source_key")
        g = int(pdf["group"].iloc[0])
        m = split_tree(pdf["quota"].to_numpy(np.int64), by_group[g], np.random.default_rng([seed, g]))
        return pd.DataFrame({"source_key": pdf["source_key"], "upto": [c.tolist() for c in np.cumsum(m, axis=1)]})

    ends = quotas.groupBy("group").applyInPandas(split_group, "source_key string, upto array<long>")
    draws = blocks.withColumn("pass", F.explode(F.sequence(F.lit(1), quota))).where(quota > 0)
    turn = Window.partitionBy("source_key").orderBy(F.xxhash64("source_key", "block", "pass", F.lit(seed + 1)), "block", "pass")
    placed = (
        draws.withColumn("turn", F.row_number().over(turn) - 1)
        .join(ends, "source_key")
        .withColumn("shard", F.size(F.filter("upto", lambda e: e <= F.col("turn"))))
        .groupBy("source_key", "block")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("pass"), F.col("shard"), (F.col("pass") > F.col("passes")).alias("last")))).alias("placed"), F.first("more").alias("more"))
    )
    decided = written(placed.join(partial, ["source_key", "block"], "left"), "mix-decided")

    joined = with_block(rows).join(decided, ["source_key", "block"], "left")
    part = F.coalesce(F.element_at(F.map_from_arrays(F.coalesce("hs", F.array().cast("array<long>")), F.coalesce("ws", F.array().cast("array<long>"))), F.col("h")), F.lit(0))
    took = F.transform(
        F.coalesce("placed", F.array().cast("array<struct<pass:int,shard:int,last:boolean>>")),
        lambda p: F.struct(
            p["shard"].alias("shard"),
            F.xxhash64(F.col("h"), p["pass"], F.lit(seed + 2)).alias("position"),
            F.when(p["last"] & (F.col("more") == "part"), part).otherwise(F.col("size")).cast("long").alias("words"),
        ),
    )
    whole = F.filter(took, lambda d: (d["words"] > 0) | (F.col("size") == 0))
    out = joined.select("__row__.*", "size", "source_size", "target", whole.alias("draws"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", taken.alias("taken"), "draws")

"""Hard negatives by Kronecker-packed products.

Vectors are scaled to integers. A block of candidates is packed once: each component of several
candidates is biased to be non-negative and laid into its own field of one wide integer, so that an
anchor's component, multiplied once with that integer, is multiplied with all of them. The products of
all components are added modulo the integer's size; taking off the bias and adding an offset that no
score exceeds leaves every candidate's exact score in its field. The width of a field is that of the
largest possible score (Cauchy-Schwarz over the table's longest vector); where several don't fit into 64
bits, the integers are Python's own, so vectors of any size have exact scores.

Anchors and candidates meet in cells, a block of each: one pass finds every anchor's positives among the
blocks of its label's group, a second one the negatives below each of them among all blocks. A cell
returns its best few of each, and Spark ranks those of all cells. No task holds more than a cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentscan.llm.common import written

#: Candidates and anchors of a block, on average at most, and groups that labels are hashed to.
BLOCK, CHUNK, GROUPS = 8192, 4096, 16
#: Anchors that are multiplied with a block at once, bits of a field that numpy's integers hold, and
#: candidates in one integer beyond that.
AT_ONCE, NARROW, WIDE = 128, 47, 4
#: What stands for a score that 38 digits do not hold.
MOST = 10**38 - 1


def layout(largest: float, longest: float) -> tuple[int, int, int]:
    """Bias, offset and field width for components of at most ``largest`` and vectors of squared length ``longest``."""
    bias = int(largest * (1 + 1e-9)) + int(largest > 0)
    offset = int(longest * (1 + 1e-9)) + 1 + bias
    return bias, offset, (2 * offset).bit_length()


def _shape(width: int) -> tuple[int, int]:
    """Fields of one integer, and its bytes."""
    fields = 64 // width if width <= NARROW else WIDE
    return fields, 8 if width <= NARROW else -(-width * fields // 8)


def pack(parts: np.ndarray, bias: int, width: int) -> bytes:
    """Rows of components as wide integers: that of rows j to j + fields - 1 and one component after the other."""
    fields, size = _shape(width)
    n, dim = parts.shape
    words = -(-n // fields)
    kind = np.uint64 if width <= NARROW else object
    shifted = np.zeros((words * fields, dim), kind)
    shifted[:n] = (parts + bias).astype(kind) if width <= NARROW else parts.astype(object) + bias
    wide = np.zeros((words, dim), kind)
    for f in range(fields):
        wide += shifted[f::fields] * kind(2 ** (width * f)) if width <= NARROW else shifted[f::fields] * 2 ** (width * f)
    return wide.tobytes() if width <= NARROW else b"".join(int(x).to_bytes(size, "little") for x in wide.ravel())


def unpacked(raw: bytes, n: int, dim: int, width: int) -> np.ndarray:
    """The wide integers of ``n`` candidates, one row for each integer's candidates."""
    fields, size = _shape(width)
    shape = (-(-n // fields), dim)
    if width <= NARROW:
        return np.frombuffer(raw, np.uint64).reshape(shape)
    return np.array([int.from_bytes(raw[i : i + size], "little") for i in range(0, len(raw), size)], object).reshape(shape)


def scores(anchors: np.ndarray, wide: np.ndarray, n: int, bias: int, offset: int, width: int) -> np.ndarray:
    """Exact inner products of ``anchors`` (rows) with the ``n`` packed candidates."""
    fields, _ = _shape(width)
    ones = sum(2 ** (width * f) for f in range(fields))
    if width <= NARROW:
        total = anchors.astype(np.int64).view(np.uint64) @ wide.T
        rest = (offset - bias * anchors.sum(1)).astype(np.int64).view(np.uint64) * np.uint64(ones)
        mask, step = np.uint64(2**width - 1), [np.uint64(width * f) for f in range(fields)]
        out = np.empty((len(anchors), len(wide) * fields), np.int64)
    else:
        total = anchors.astype(object) @ wide.T if wide.shape[1] else np.zeros((len(anchors), len(wide)), object)
        rest = np.array([(offset - bias * sum(int(x) for x in a)) * ones for a in anchors], object)
        mask, step = 2**width - 1, [width * f for f in range(fields)]
        out = np.empty((len(anchors), len(wide) * fields), object)
    total = total + rest[:, None]
    for f in range(fields):
        field = (total >> step[f]) & mask
        out[:, f::fields] = (field.astype(np.int64) if width <= NARROW else field) - offset
    return out[:, :n]


def best(score: np.ndarray, valid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``most`` largest valid scores; ties go to the smaller column."""
    n = score.shape[1]
    if score.dtype == object:
        found = [(i, j) for i in range(len(score)) for j in heapq.nsmallest(most, np.flatnonzero(valid[i]).tolist(), key=lambda j, i=i: (-score[i, j], j))]
        return np.array([i for i, _ in found], np.int64), np.array([j for _, j in found], np.int64)
    none = np.iinfo(np.int64).min
    key = np.where(valid, score * n - np.arange(n), none)
    if n > most:
        at = np.argpartition(key, n - most, axis=1)[:, n - most :]
        i, j = np.repeat(np.arange(len(key)), most), at.ravel()
    else:
        i, j = np.repeat(np.arange(len(key)), n), np.tile(np.arange(n), len(key))
    keep = key[i, j] != none
    return i[keep], j[keep]


def _decimals(score: np.ndarray) -> pa.Array:
    if score.dtype == object:
        return pa.array([Decimal(max(-MOST, min(MOST, int(s)))) for s in score], pa.decimal128(38, 0))
    return pa.array(score, pa.int64()).cast(pa.decimal128(38, 0))


_PACKED = "dim int, grp int, part int, largest double, longest double, ids binary, labels array<string>, packed binary"
_CHUNK = "dim int, grp int, chunk int, ids binary, same binary, labels array<string>, parts binary, bars array<array<decimal(38,0)>>"
_FOUND = "anchor long, same long, bar int, id long, score decimal(38,0)"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.array(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), dim)


def _packed(group: pa.Table) -> pa.Table:
    group = group.sort_by("id")
    dim = group["dim"][0].as_py()
    largest, longest = group["largest"][0].as_py(), group["longest"][0].as_py()
    bias, _, width = layout(largest, longest)
    raw = pack(_matrix(group["parts"], dim), bias, width)
    values = [dim, group["grp"][0].as_py(), group["part"][0].as_py(), largest, longest, group["id"].to_numpy().astype(np.int64).tobytes(), group["label"].to_pylist(), raw]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.binary()]
    return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["dim", "grp", "part", "largest", "longest", "ids", "labels", "packed"])


def _chunk(group: pa.Table) -> pa.Table:
    dim = group["dim"][0].as_py()
    values = [dim, group["grp"][0].as_py(), group["chunk"][0].as_py(), group["id"].to_numpy().astype(np.int64).tobytes(), group["same"].to_numpy().astype(np.int64).tobytes(), group["label"].to_pylist(), _matrix(group["parts"], dim).tobytes(), group["bars"].to_pylist()]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.list_(pa.decimal128(38, 0)))]
    return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["dim", "grp", "chunk", "ids", "same", "labels", "parts", "bars"])


def _cell(most: int, low: int | None, high: int | None):
    """The best ``most`` candidates of a cell: of the anchor's label, or, with bounds, of the others for each of its bars."""

    def run(chunk: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if chunk.num_rows and block.num_rows:
            a, b = chunk.to_pylist()[0], block.to_pylist()[0]
            dim = a["dim"]
            bias, offset, width = layout(b["largest"], b["longest"])
            ids = np.frombuffer(b["ids"], np.int64)
            wide = unpacked(b["packed"], len(ids), dim, width)
            anchor, same = np.frombuffer(a["ids"], np.int64), np.frombuffer(a["same"], np.int64)
            parts = np.frombuffer(a["parts"], np.int64).reshape(len(anchor), dim)
            _, code = np.unique(np.array(a["labels"] + b["labels"], object).astype(str), return_inverse=True)
            own, theirs = code[: len(anchor)], code[len(anchor) :]
            for at in range(0, len(anchor), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                score = scores(parts[part], wide, len(ids), bias, offset, width)
                alike = own[part, None] == theirs
                if low is None:
                    tries = [(0, alike & (anchor[part, None] != ids))]
                else:
                    bars = a["bars"][part]
                    tries = []
                    for k in range(max(map(len, bars), default=0)):
                        bar = np.array([int(x[k]) if len(x) > k else -1 for x in bars], score.dtype)[:, None]
                        tries.append((k, ~alike & (anchor[part, None] != ids) & (low * bar <= 100 * score) & (100 * score <= high * bar)))
                for k, valid in tries:
                    i, j = best(score, valid.astype(bool), most)
                    if len(i):
                        out.append((anchor[part][i], same[part][i], np.full(len(i), k, np.int32), ids[j], score[i, j]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2].astype(np.int32)), pa.array(cols[3], pa.int64()), _decimals(cols[4])], names=["anchor", "same", "bar", "id", "score"])

    return run


def _ranked(found: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "same", "bar").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def hard_negatives(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its ``positives``
    best other rows of its label, and each positive has the ``negatives`` best rows of other labels whose
    score is ``low`` to ``high`` hundredths of the positive's. Components are floor(``scale`` * x); a
    score is their exact inner product, ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Repeated rows
    count once; rows of one id with different vectors or labels count each, but never for each other.
    Zero and empty vectors take part, with scores of 0; vectors of other lengths are other spaces. A scaled component beyond a
    long is taken as the nearest long; a score that a long doesn't hold is null, and beyond 38 digits
    ties are told apart by id alone. Fewer candidates give fewer rows, none or an empty table no rows.
    Extra columns are ignored.
    """
    v = F.col(f"`{vector}`")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.transform(v, lambda x: x.cast("double")).alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    rows = rows.select("id", "label", F.transform("vec", lambda x: F.floor(x * scale)).alias("parts")).distinct()
    rows = rows.withColumn("dim", F.size("parts")).withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))
    rows = written(rows.withColumn("same", F.xxhash64("label", "parts")), "rows")

    asks = F.pmod("id", F.lit(every)) == 0
    real = F.transform("parts", lambda x: x.cast("double"))
    sizes = rows.select("dim", "grp", asks.alias("asks"), F.array_max(F.transform(real, F.abs)).alias("largest"), F.aggregate(real, F.lit(0.0), lambda s, x: s + x * x).alias("longest"))
    count = lambda n, per: F.ceil(n / per).cast("int")
    sizes = sizes.groupBy("dim", "grp").agg(count(F.count("*"), BLOCK).alias("parts_n"), count(F.count_if("asks"), CHUNK).alias("chunks"), F.max("largest").alias("largest"), F.max("longest").alias("longest"))
    # a row for each length of vectors: its GROUPS groups at most, and its bounds
    grid = written(sizes.groupBy("dim").agg(F.collect_list(F.struct("grp", "parts_n", "chunks")).alias("groups"), F.coalesce(F.max("largest"), F.lit(0.0)).alias("largest"), F.coalesce(F.max("longest"), F.lit(0.0)).alias("longest")), "grid")
    own = lambda field: F.filter("groups", lambda g: g["grp"] == F.col("grp"))[0][field]
    dealt = lambda field: F.pmod(F.xxhash64("id", "same", F.lit("deal")), own(field)).cast("int")

    placed = rows.join(grid, "dim")
    packed = placed.select("dim", "grp", dealt("parts_n").alias("part"), "id", "label", "parts", "largest", "longest")
    packed = written(packed.groupBy("dim", "grp", "part").applyInArrow(_packed, _PACKED), "packed")
    anchors = written(placed.where(asks).select("dim", "grp", dealt("chunks").alias("chunk"), "id", "same", "label", "parts"), "anchors")

    def met(asking: DataFrame, own_group: bool, cell) -> DataFrame:
        """What every anchor block finds in every block of its group, or of all groups."""
        chunks = written(asking.groupBy("dim", "grp", "chunk").applyInArrow(_chunk, _CHUNK), "chunks")
        other = lambda: F.explode(F.filter("groups", lambda g: g["grp"] == F.col("grp")) if own_group else F.col("groups")).alias("g")
        left = chunks.join(grid.select("dim", "groups"), "dim").select("*", other()).select(*chunks.columns, F.col("g.grp").alias("to"), F.explode(F.sequence(F.lit(0), F.col("g.parts_n") - 1)).alias("part"))
        right = packed.join(grid.select("dim", "groups"), "dim").select("*", other()).where("g.chunks > 0")
        right = right.select(*packed.columns, F.col("g.grp").alias("from"), F.explode(F.sequence(F.lit(0), F.col("g.chunks") - 1)).alias("chunk"))
        return left.groupBy("dim", "grp", "chunk", "to", "part").cogroup(right.groupBy("dim", "from", "chunk", "grp", "part")).applyInArrow(cell, _FOUND)

    none = F.array().cast("array<decimal(38,0)>")
    near = written(_ranked(met(anchors.withColumn("bars", none), True, _cell(positives, None, None)), positives), "positives")
    bars = near.groupBy("anchor", "same").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("near"))
    asking = anchors.join(bars.select(F.col("anchor").alias("id"), "same", F.transform("near", lambda n: n["score"]).alias("bars")), ["id", "same"])
    hard = _ranked(met(asking, False, _cell(negatives, low, high)), negatives)
    firsts = near.select("anchor", "same", (F.col("place") - 1).alias("bar"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(firsts, ["anchor", "same", "bar"])
    return out.select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        F.col("place").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("positive_score").try_cast("long").alias("positive_score"),
        F.col("score").try_cast("long").alias("negative_score"),
    )


def of_blocks(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of exact scores of ``anchors`` with ``candidates``, packed here: the product alone, for use outside Spark."""
    far = np.concatenate([anchors, candidates]).astype(np.float64)
    bias, offset, width = layout(np.abs(far).max(initial=0), (far**2).sum(1).max(initial=0))
    wide = unpacked(pack(candidates, bias, width), len(candidates), candidates.shape[1], width)
    for at in range(0, len(anchors), AT_ONCE):
        yield from scores(anchors[at : at + AT_ONCE], wide, len(candidates), bias, offset, width)

"""Document fingerprints by winnowing.

Every run of GRAM code points has a rolling hash; of each window of WINDOW neighbouring hashes the
smallest is kept, the rightmost among equal ones, with its position. Two texts that share a passage of
GRAM + WINDOW - 1 code points share a whole window and so the kept hash and its place in the passage;
what is kept depends on the text alone. A text of fewer than GRAM code points is one run, and one of
fewer than WINDOW runs is one window. Texts are read whole, in pieces that overlap by a window.

A fingerprint is a string of ENTRY hexadecimal digits for each kept hash: twelve of the hash and two of
the distance to the kept position before (at the first: to the text's beginning), which no window exceeds.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentscan.llm.common import map_text

#: Code points of a run and runs of a window (255 at most, as distances are two digits).
GRAM, WINDOW = 12, 32
ENTRY = 14
#: Windows of a text that are read at once; with a window more, positions fit into 16 bits.
PIECE = 1 << 15
BASE, SPREAD = 6364136223846793005, 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    a = np.full(PIECE + WINDOW + GRAM, base, np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a)


_UP, _DOWN = _powers(BASE), _powers(pow(BASE, -1, 2**64))
_PLACE = np.uint64(0xFFFF)


def _runs(codes: np.ndarray, gram: int) -> np.ndarray:
    """The polynomial hash of each run, each from the sums before its ends; spread, so that the upper bits depend on all."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * _DOWN[: len(codes)], out=sums[1:])
    return (sums[gram:] - sums[:-gram]) * _UP[gram - 1 : len(codes)] * np.uint64(SPREAD)


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    """The smallest key of each window, by windows of doubling length."""
    size = 1
    while 2 * size <= window:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (window - size)], keys[window - size :])


def winnow(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes (48 bits) and their positions in code points, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = min(GRAM, len(codes))
    runs = len(codes) - gram + 1
    window = min(WINDOW, runs)
    kept = []
    for at in range(0, runs - window + 1, PIECE):
        part = _runs(codes[at : at + PIECE + window - 1 + gram - 1], gram)
        # the smaller of equal hashes is the one further right
        least = _least((part & ~_PLACE) | (_PLACE - np.arange(len(part), dtype=np.uint64)), window)
        kept.append((least >> np.uint64(16), (_PLACE - (least & _PLACE)).astype(np.int64) + at))
    hashes, places = (np.concatenate(x) for x in zip(*kept, strict=True))
    new = np.concatenate([[True], places[1:] != places[:-1]])
    return hashes[new], places[new]


def written_as(hashes: np.ndarray, places: np.ndarray) -> str:
    rows = np.empty((len(hashes), 7), np.uint8)
    rows[:, :6] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    rows[:, 6] = np.diff(places, prepend=0)
    return rows.tobytes().hex()


def read_back(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a fingerprint."""
    rows = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 7)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, 2:] = rows[:, :6]
    return wide.view(">u8").ravel().astype(np.uint64), np.cumsum(rows[:, 6].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two texts' kept hashes as sets; two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return both / (len(a) + len(b) - both)


def entries(fingerprint: Column) -> Column:
    """An array of (hash, position) of a fingerprint, for joins on shared passages."""
    n = (F.length(fingerprint) / ENTRY).cast("int")
    part = lambda i, a, k: F.substring(fingerprint, i * ENTRY + 1 + a, k)
    steps = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(part(i, F.lit(0), F.lit(12)).alias("hash"), F.conv(part(i, F.lit(12), F.lit(2)), 16, 10).cast("long").alias("position"))))
    start = F.struct(F.array().cast("array<struct<hash:string,position:bigint>>").alias("all"), F.lit(0).cast("long").alias("at"))
    step = lambda s, e: F.struct(F.concat(s["all"], F.array(F.struct(e["hash"].alias("hash"), (s["at"] + e["position"]).alias("position")))).alias("all"), (s["at"] + e["position"]).alias("at"))
    return F.coalesce(F.aggregate(steps, start, step, lambda s: s["all"]), F.array().cast("array<struct<hash:string,position:bigint>>"))


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with each whole text's fingerprint; a null or empty text has an empty one.

    Repeated rows stay, each for itself; a column named ``fingerprint`` is replaced; an empty table stays empty.
    """

    def make():
        return lambda part: [pa.array([written_as(*winnow(t.as_py() or "")) for t in part.column("__text__")], pa.string())]

    return map_text(docs, text, T.StructType([T.StructField("fingerprint", T.StringType())]), make, keep)


def _order(value) -> tuple:
    """A key of (id, hash) as Spark orders structs: null before all others."""
    return (value[0] is not None, value[0] if value[0] is not None else 0, value[1])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with what follows it in its range; rows come in the order of range, borrowed, id."""
    before = None
    for batch in batches:
        out: list[tuple] = []
        for part, borrowed, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "borrowed", "doc_id", "text")), strict=True):
            hashes, places = winnow(text)
            if before is not None and before[0] == part and not before[1]:
                _, _, own_id, own, own_hashes, own_places = before
                swapped = len(own) // 3
                edited = own[: len(own) - swapped] + text[:swapped]
                edited_hashes, edited_places = winnow(edited)
                out.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written_as(own_hashes, own_places), written_as(edited_hashes, edited_places), likeness(own_hashes, edited_hashes), likeness(own_hashes, hashes)))
            before = (part, borrowed, doc_id, text, hashes, places)
        if out:
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def edited_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text: its last third replaced from the next document.

    Next is the document of the next smaller id; null ids follow all others, ties follow the texts' hashes,
    and the last document is followed by the first (a single one by itself). Null texts are empty, and
    empty ones have empty fingerprints, alike to each other and to no other. Repeated rows are documents of
    their own that follow each other. An empty table stays empty; other columns are ignored.

    Texts move once: a job over ids alone finds each range's first id, the range itself takes its
    documents and borrows the next range's first. Within a range texts are read one after another; only
    rows of one id and one text can't be told apart and share a range.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("hash"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("doc_id", "hash").alias("key")
    firsts = rows.select(key).repartitionByRange(ranges, F.desc("key")).groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("first")).collect()  # one row a range
    firsts = sorted(_order(r["first"]) for r in firsts)
    n = max(1, len(firsts))

    @F.arrow_udf("long")
    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """Twice the range, and one more where the row is its first."""
        keys = [_order(k) for k in zip(ids.to_pylist(), hashes.to_pylist(), strict=True)]
        at = [bisect_left(firsts, k) for k in keys]
        return pa.array([2 * (n - 1 - i) + (firsts[i] == k) for i, k in zip(at, keys, strict=True)], pa.int64())

    placed = rows.withColumn("place", place("doc_id", "hash"))
    part, first = F.floor(F.col("place") / 2).cast("int"), F.col("place") % 2 == 1
    own, lent = F.struct(part.alias("part"), F.lit(False).alias("borrowed")), F.struct(F.pmod(part - 1, F.lit(n)).alias("part"), F.lit(True).alias("borrowed"))
    dealt = placed.select("doc_id", "text", "hash", F.explode(F.when(first, F.array(own, lent)).otherwise(F.array(own))).alias("to")).select("doc_id", "text", "hash", "to.*")
    sorted_ = dealt.repartition(ranges, "part").sortWithinPartitions("part", "borrowed", F.desc("doc_id"), F.desc("hash")).select("part", "borrowed", "doc_id", "text")
    kept = T.StructType([docs.schema[doc_id] if doc_id == "doc_id" else T.StructField("doc_id", docs.schema[doc_id].dataType)])
    made = kept.add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")
    return sorted_.mapInArrow(_compared, made)

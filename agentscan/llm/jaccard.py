"""N-gram Jaccard join with Bayesian candidate pruning of MinHash comparisons.

1. Every text becomes its set of word shingles: a 128-bit key of the set, and 128 MinHash values of
   16 bits. Texts with equal sets form a class; only classes go on, so copies are never paired.
2. Bands of MinHash values put classes into buckets. Members of a bucket are compared block by block,
   a pair only in the first bucket that it shares: some MinHash values at a time, and a pair is dropped
   once the posterior probability that its similarity reaches the threshold falls below a tolerance.
   What is left joins classes into clusters (only spanning links leave a task).
3. A cluster's texts meet, again block by block. The pairs that survive the same comparison, and no
   others, are verified exactly on their shingles, each once. Verified links are counted for each
   class, and spanning links give the final groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentscan.llm.common import discard, map_text, utf8, written
from agentscan.llm.words import mix, shingles, words

SHINGLE = 5
THRESHOLD = 0.8
#: MinHash values; BANDS bands of ROWS of them make the buckets: at similarity 0.8 all but one
#: pair in twenty thousand share one.
VALUES, BANDS, ROWS = 128, 25, 5
#: Comparisons after which a pair is judged, and the posterior probability below which it is dropped.
STEPS = (16, 32, 64, 128)
TOLERANCE = 1e-5
#: Members of a block of a bucket (signatures), and members and bytes of a block of a cluster (texts).
BUCKET_BLOCK, CLUSTER_BLOCK, BLOCK_BYTES = 512, 384, 1 << 25

_RNG = np.random.default_rng(20240)
_A = _RNG.integers(1, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def minhash(sh: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts' MinHash values, 16 bits each; texts without shingles get zeros."""
    some = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, VALUES), np.uint16)
    step = 1 << 16  # shingles at a time, so that they stay in cache
    at = 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[some[at]] + step, "right")) - 1)
        group = some[at : np.searchsorted(some, end)] if end > some[at] else some[at : at + 1]
        x = sh[offsets[group[0]] : offsets[group[-1] + 1]]
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = offsets[group] - offsets[group[0]]
        for v in range(VALUES):
            least = np.minimum.reduceat(x * _A[v] + _B[v], starts)
            out[group, v] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
        at += len(group)
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each step, the matches that a pair needs to stay.

    With a uniform prior, P(J >= t | m of n values agree) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in STEPS:
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def likely(a: np.ndarray, b: np.ndarray, need: list[int]) -> np.ndarray:
    """Indices of the pairs (rows of a and b) that survive the comparison, step by step."""
    left, matches, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, m in zip(STEPS, need, strict=True):
        matches = matches + (a[left, done:n] == b[left, done:n]).sum(1, dtype=np.int32)
        ok = matches >= m
        left, matches, done = left[ok], matches[ok], n
    return left


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within groups that follow each other."""
    start = np.cumsum(sizes) - sizes
    first = np.arange(int(sizes.sum()))
    more = np.repeat(start + sizes, sizes) - first - 1
    i = np.repeat(first, more)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each row's component under the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``, joined up to about ``most`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(held)
        change = _changes(t, keys)
        if len(change) > 1:
            yield t.slice(0, int(change[-1]))
            held = t.slice(int(change[-1])).combine_chunks().to_batches()
            rows = sum(x.num_rows for x in held)
    if rows:
        yield pa.Table.from_batches(held)


def _changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a group begins."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = t[k].combine_chunks()
        v = np.frombuffer(b"".join(x.to_pylist()), "S16") if pa.types.is_binary(x.type) else x.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _bucket_links(need: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["bucket", "bi", "bj"], 4096):
            begin = _changes(t, ["bucket", "bi", "bj"])
            sizes = np.diff(np.append(begin, t.num_rows))
            sig, key = _matrix(t["sig"], np.uint16, VALUES), t["key"].to_pylist()
            band, blk = t["band"].to_numpy(), t["blk"].to_numpy()
            cross = t["bi"].to_numpy() != t["bj"].to_numpy()
            at = 0
            while at < len(sizes):  # groups of some 100,000 pairs at a time
                end = at + max(1, int(np.searchsorted(np.cumsum((sizes[at:] * (sizes[at:] - 1)) // 2), 100_000, "right")))
                lo, hi = begin[at], begin[end] if end < len(sizes) else t.num_rows
                i, j = _pairs(sizes[at:end])
                i, j = i + lo, j + lo
                ok = ~cross[i] | (blk[i] != blk[j])
                i, j = i[ok], j[ok]
                links = []
                for c in range(0, len(i), 50_000):
                    x, y = i[c : c + 50_000], j[c : c + 50_000]
                    stay = likely(sig[x], sig[y], need)
                    x, y = x[stay], y[stay]
                    same = (sig[x, : BANDS * ROWS] == sig[y, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(2)
                    first = same.argmax(1) == band[x]  # each pair counts in the first bucket it shares
                    links.append((x[first], y[first]))
                x, y = np.concatenate([k[0] for k in links] or [i]), np.concatenate([k[1] for k in links] or [j])
                if len(x):
                    root = _roots(hi - lo, x - lo, y - lo) + lo
                    far = np.flatnonzero(root != np.arange(lo, hi)) + lo
                    yield pa.RecordBatch.from_arrays([pa.array([key[k] for k in far], pa.binary()), pa.array([key[root[k - lo]] for k in far], pa.binary())], names=["u", "v"])
                at = end

    return run


def _verified(threshold: Fraction, k: int, need: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["cluster", "bi", "bj"], 64):
            begin = np.append(_changes(t, ["cluster", "bi", "bj"]), t.num_rows)
            for lo, hi in zip(begin[:-1], begin[1:], strict=True):
                if hi - lo > 1:
                    yield from _verify_group(t.slice(int(lo), int(hi - lo)), threshold, k, need)

    return run


def set_keys(sh: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each text's set of shingles; None without shingles."""
    return [hashlib.blake2b(np.unique(sh[a:b]).tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _sets(column: pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """The sets of shingles of texts; beyond 2 GB these stand in several chunks."""
    out = []
    for chunk in column.chunks:
        sh, off = shingles(*words(*utf8(chunk)), k)
        out += [np.unique(sh[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    return out


def _verify_group(g: pa.Table, threshold: Fraction, k: int, need: list[int]) -> Iterator[pa.RecordBatch]:
    """Exact links among the members of a block, or between two blocks, of a cluster."""
    key, sets = g["key"].to_pylist(), _sets(g["text"], k)
    n = np.array([len(s) for s in sets], np.int64)
    sig, copies, blk = _matrix(g["sig"], np.uint16, VALUES), g["n"].to_numpy(), g["blk"].to_numpy()
    cross = g["bi"][0].as_py() != g["bj"][0].as_py()
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(n) - n
    mark = np.zeros(int(ids.max()) + 1, np.int64)
    docs, x, y = np.zeros(len(n), np.int64), [], []
    for m in range(len(n) - 1):
        rest = np.flatnonzero(blk[m + 1 :] != blk[m]) + m + 1 if cross else np.arange(m + 1, len(n))
        # sets of very different sizes can't be similar enough
        rest = rest[np.minimum(n[rest], n[m]) * threshold.denominator >= np.maximum(n[rest], n[m]) * threshold.numerator]
        rest = rest[likely(np.broadcast_to(sig[m], (len(rest), VALUES)), sig[rest], need)]
        if not len(rest):
            continue
        own = ids[starts[m] : starts[m] + n[m]]
        mark[own] = 1
        size = n[rest]
        at = np.repeat(starts[rest] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        both = np.add.reduceat(mark[ids[at]], np.cumsum(size) - size)
        mark[own] = 0
        hit = rest[both * threshold.denominator >= threshold.numerator * (size + n[m] - both)]
        docs[m] += copies[hit].sum()
        docs[hit] += copies[m]
        x += [m] * len(hit)
        y += hit.tolist()
    if x:
        root = _roots(len(n), np.array(x), np.array(y))
        some = np.unique(np.array(x + y))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[m] for m in some], pa.binary()), pa.array([key[root[m]] for m in some], pa.binary()), pa.array(docs[some]), pa.array([g["blocks"][0].as_py() == 1] * len(some))],
            names=["u", "v", "near_docs", "whole"],
        )


def _told(df: DataFrame, tag: str) -> tuple[DataFrame, tuple]:
    """``df`` (u, v) written, and the number and a hash of its rows."""
    out = written(df, tag)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return out, (r["n"], r["h"])


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the links (u, v), root the least node of its component.

    Large-star and small-star steps in turn, each a few joins and aggregates; what is between is
    written to the shared folder, a star's least neighbours too, so that the join with them shuffles
    both sides and a star's many rows can be split. A star of any size is many rows and not one.
    """
    e, last = _told(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")  # u has its smaller neighbours alone, so few rows
        before = e
        e, now = _told(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u != v").distinct(), "links")
        discard(before, least)
        if now == last:
            break
        last = now
    return e.select("u", F.col("v").alias("root"))


ADDED = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("sig", T.BinaryType())])


def _sign(k: int):
    def work(part: pa.RecordBatch) -> list[pa.Array]:
        sh, off = shingles(*words(*utf8(part.column("__text__"))), k)
        keys, sig = set_keys(sh, off), minhash(sh, off)
        return [pa.array(keys, pa.binary()), pa.array([s.tobytes() if x else None for s, x in zip(sig, keys, strict=True)], pa.binary())]

    return work


def _blocks(df: DataFrame, n) -> DataFrame:
    """Rows dealt to the pairs of their group's ``n`` blocks (bi <= bj)."""
    blk = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("blk")).alias("bi"), F.greatest(o, F.col("blk")).alias("bj"))))
    return df.withColumn("blocks", n.cast("int")).withColumn("blk", blk).withColumn("p", pair).withColumns({"bi": F.col("p.bi"), "bj": F.col("p.bj")}).drop("p")


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_hash, copy_class, class_id, n_links.

    copy_class: the least doc_id with the same set of shingles; class_id: the least doc_id of the
    documents that links of similarity ``threshold`` or more connect; n_links: the other documents
    at that similarity, copies included. text_hash is xxhash64 of the text, to join the result to
    rows of equal doc_id and different text.

    A text of fewer than ``k`` words is one shingle. Null and wordless texts have no links and are
    a class alone. Repeated rows are documents too and link to each other. A null doc_id is used as
    a class's id only if all its ids are null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    need, exact = least_matches(threshold, TOLERANCE), Fraction(str(threshold))
    body = F.col(f"`{text}`")
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"), F.octet_length(body).cast("long").alias("bytes"))
    signed = written(map_text(base, "text", ADDED, lambda: _sign(k), ["doc_id", "text_hash", "bytes"]), "signed")
    classes = written(signed.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("copy_class"), F.min(F.struct("doc_id", "text_hash", "bytes")).alias("one"), F.first("sig").alias("sig")), "classes")

    bands = classes.select("key", F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.expr(f"substring(sig, {2 * ROWS * b + 1}, {2 * ROWS})")) for b in range(BANDS)])).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = bands.join(shared, "bucket").join(classes.select("key", "sig"), "key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _blocks(members, F.ceil(F.col("m") / F.lit(BUCKET_BLOCK))).repartition(parts, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    near = dealt.select("bucket", "bi", "bj", "blk", "band", "key", "sig").mapInArrow(_bucket_links(need), "u binary, v binary")
    cluster = components(near)
    cluster = cluster.unionByName(cluster.select(F.col("root").alias("u"), "root").distinct())

    # sorted and merged at every size, so that cost grows with the texts and never jumps
    own = cluster.select(F.col("u").alias("key"), F.col("root").alias("cluster")).join(classes.select("key", "n", "one"), "key")
    own = written(own.select("key", "cluster", "n", F.col("one.doc_id").alias("w_id"), F.col("one.text_hash").alias("w_hash"), F.col("one.bytes").alias("bytes")), "own")
    sizes = written(own.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).alias("blocks")), "sizes")
    wanted = written(own.join(sizes, "cluster").select("key", "cluster", "n", "w_id", "w_hash", F.least("blocks", F.lit(1 << 30)).cast("int").alias("blocks")), "wanted")
    texts = base.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))).select("key", "cluster", "n", "blocks", "text").dropDuplicates(["key"])  # a repeated row is one text
    met = _blocks(texts.join(classes.select("key", "sig"), "key"), F.col("blocks")).repartition(parts, "cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj")
    links = written(met.select("cluster", "bi", "bj", "blk", "blocks", "key", "n", "sig", "text").mapInArrow(_verified(exact, k, need), "u binary, v binary, near_docs long, whole boolean"), "verified")

    # a cluster of one block has its groups already; those of several blocks are joined up
    root = links.where("whole").select("u", F.col("v").alias("root")).unionByName(components(links.where("not whole").select("u", "v")))
    counts = links.groupBy(F.col("u").alias("key")).agg(F.sum("near_docs").alias("near_docs"))
    tied = classes.select("key", "n", "copy_class").join(counts, "key", "left").join(root.withColumnRenamed("u", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    tied = written(tied, "tied")
    group = written(tied.groupBy("root").agg(F.min("copy_class").alias("class_id")), "groups")  # so that the join shuffles both sides, and a large group's rows can be split
    result = tied.join(group, "root").select("key", "copy_class", "class_id", (F.col("n") - 1 + F.coalesce("near_docs", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "text_hash", "key").join(result, "key", "left").select("doc_id", "text_hash", F.coalesce("copy_class", F.when(F.col("key").isNull(), F.col("doc_id"))).alias("copy_class"), F.coalesce("class_id", F.when(F.col("key").isNull(), F.col("doc_id"))).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are hashed by several tables of Gaussian projections cut into cells. A query visits in each
table its own bucket and the neighbouring ones in order of their estimated success, the least sum of
squared distances to the crossed cell borders first. Buckets meet their visitors in tasks, a large
bucket in several parts. What travels there is no vector but a code of two bytes a component, with the
distance between the two: it bounds every cosine from below and above, closely enough (some 0.0001) to
rank near copies, so that a query among many of them keeps a few and not all. A query's nearest among a
sixteenth of the index, 2,048 entries at most, are a floor for its nearest of all, and only candidates that floor or bounds rule out
are left behind. The candidates of all tables are merged, and what is left is ranked by the exact cosine
of the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentscan.llm.common import written

TABLES, PROJECTIONS, PROBES = 8, 5, 30
#: Width of a cell, where the projections of unit vectors have standard deviation 1.
WIDTH = 1.5
NEAREST = 5
#: Steps of a code to either side of nought.
STEPS = 32_767
#: Distinct vectors of a bucket that one part holds at most.
PART = 2048
#: One entry in so many is in the sample that gives a query its floor, and how many are at most: the floor lies
#: some SAMPLE_PART times as deep as the neighbours that are sought, at any size of the index.
SAMPLE_PART, SAMPLE = 16, 2048
#: Candidates that a task holds before it returns them, and the entries and queries of one cell of the exact pass.
HELD, EXACT_ENTRIES, EXACT_QUERIES = 200_000, 16_384, 1024


def _parameters(dim: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def probes(inside: np.ndarray, most: int) -> list[np.ndarray]:
    """Steps (-1, 0, 1 for each projection) to visited buckets, in order of estimated success.

    ``inside`` holds a query's places within its cells, 0 to 1. Sets of crossed borders are made from
    the cheapest upward with a heap, by replacing or adding the next costlier border.
    """
    m = len(inside)
    cost = np.concatenate([inside, 1 - inside]) ** 2
    order = np.argsort(cost, kind="stable")
    cost = cost[order]
    out, heap = [np.zeros(m, np.int64)], [(cost[0], (0,))]
    while heap and len(out) < most:
        total, chosen = heapq.heappop(heap)
        borders = order[list(chosen)]
        if len({b % m for b in borders}) == len(borders):
            step = np.zeros(m, np.int64)
            step[borders % m] = np.where(borders < m, -1, 1)
            out.append(step)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return out


def _bucket(table: int, cells: np.ndarray) -> np.ndarray:
    """64-bit names of buckets (rows of cells)."""
    h = np.full(len(cells), table + 1, np.uint64)
    for c in cells.T:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    sizes = column.value_lengths().to_numpy()
    for dim in np.unique(sizes):
        yield np.flatnonzero(sizes == dim)


def _units(column: pa.Array) -> np.ndarray:
    x = _vectors(column)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of two bytes a component, what a step is worth, and the distances of vectors from their codes."""
    scale = (np.abs(unit).max(1) / STEPS).astype(np.float32)
    code = np.rint(unit / scale[:, None]).clip(-STEPS, STEPS).astype(np.int16)
    away = np.linalg.norm(unit - code * scale[:, None].astype(np.float64), axis=1)
    return code, scale, np.nextafter(away.astype(np.float32), np.float32(9))


def _hash(visits: bool, sample: list[list[float]] = (), most: int = 1):
    """Rows of the index, one for each table, or a query's visits, with the ``most``-th cosine in the sample."""
    by_length: dict[int, list[list[float]]] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    some = {n: np.array(vs, np.float64) for n, vs in by_length.items()}
    some = {n: x / np.linalg.norm(x, axis=1, keepdims=True) for n, x in some.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _by_length(batch["vec"]):
                part = batch.take(pa.array(at))
                unit = _units(part["vec"])
                dim = unit.shape[1]
                a, b = _parameters(dim)
                place = (unit @ a + b) / WIDTH
                cell = np.floor(place)
                rows, bucket = [], []
                for t in range(TABLES):
                    cols = slice(t * PROJECTIONS, (t + 1) * PROJECTIONS)
                    if not visits:
                        rows.append(np.arange(len(unit)))
                        bucket.append(_bucket(t, cell[:, cols]))
                        continue
                    for q in range(len(unit)):
                        steps = np.array(probes(place[q, cols] - cell[q, cols], PROBES))
                        rows.append(np.full(len(steps), q))
                        bucket.append(_bucket(t, cell[q, cols] + steps))
                code, scale, away = codes(unit)
                floor = np.full(len(unit), -2.0)
                if visits and len(some.get(dim, ())) >= most:
                    score = unit @ some[dim].T
                    floor = -np.partition(-score, most - 1, axis=1)[:, most - 1] - 1e-9
                rows = np.concatenate(rows)
                raw = np.array([c.tobytes() for c in code], object)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(bucket) ^ np.int64(dim)), pa.array(np.full(len(rows), visits)), part["rep"].take(pa.array(rows)), pa.array(raw[rows], pa.binary()), pa.array(scale[rows]), pa.array(away[rows]), pa.array(floor[rows])],
                    names=["bucket", "visit", "rep", "code", "scale", "away", "floor"],
                )

    return run


def _above(query: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Places of the candidates whose upper bound reaches the ``most``-th lower bound of their query."""
    order = np.lexsort((-low, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    size = np.diff(np.append(start, len(q)))
    edge = np.where(size >= most, low[order][np.minimum(start + most - 1, len(q) - 1)], -np.inf)
    return order[high[order] >= np.repeat(edge, size)]


def _search(most: int):
    """Candidates of the buckets that follow each other: (query, rep, low, high), a query's pair once a task at most."""

    def one(t: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        visit = t["visit"].to_numpy().astype(bool)
        size = np.array([len(c) // 2 for c in t["code"].to_pylist()])
        for dim in np.unique(size):
            data, asks = (np.flatnonzero((size == dim) & (visit == v)) for v in (False, True))
            if not len(data) or not len(asks):
                continue
            raw = t["code"].to_pylist()
            floor = t["floor"].to_numpy()
            code, scale, away, rep = (lambda i, n=int(dim): np.frombuffer(b"".join(raw[k] for k in i), np.int16).reshape(-1, n).astype(np.float64)), t["scale"].to_numpy().astype(np.float64), t["away"].to_numpy().astype(np.float64), t["rep"].to_numpy()
            x = code(data)  # sums of products of codes are exact in double precision
            for a in range(0, len(asks), 256):
                q = asks[a : a + 256]
                score = (code(q) @ x.T) * scale[q][:, None] * scale[data]
                off = away[q][:, None] + (1 + away[q][:, None]) * away[data] + 1e-9
                low, high = score - off, score + off
                edge = -np.partition(-low, most - 1, axis=1)[:, most - 1] if len(data) >= most else np.full(len(q), -np.inf)
                i, j = np.nonzero(high >= np.maximum(edge, floor[q])[:, None])
                yield rep[q][i], rep[data][j], low[i, j], high[i, j]

    def pruned(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        query, rep, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
        _, once = np.unique(np.stack([query, rep]), axis=1, return_index=True)
        keep = once[_above(query[once], low[once], high[once], most)]
        return query[keep], rep[keep], low[keep], high[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for t in _groups(batches):
            for found in one(t):
                held.append(found)
                rows += len(found[0])
            if rows > HELD:
                held = [pruned(held)]
                rows = len(held[0][0])
                if rows > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["query", "rep", "low", "high"])
                    held, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pruned(held)], names=["query", "rep", "low", "high"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The parts of buckets, each as one table, from batches sorted by bucket and part."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch["bucket"].to_numpy(), batch["part"].to_numpy().astype(np.int64)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield pa.Table.from_batches(held)


def _scan(most: int):
    """(query, rep) of the ``most`` nearest of each query of a cell among its entries, by exact cosines."""

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        by_length = {len(queries["own"][int(at[0])]): at for at in _by_length(queries["own"].combine_chunks())} if queries.num_rows else {}
        for at in _by_length(entries["vec"].combine_chunks()) if by_length and entries.num_rows else ():
            part = entries.take(pa.array(at)).combine_chunks()
            x = _units(part["vec"].combine_chunks())
            if x.shape[1] not in by_length:
                continue
            asks = queries.take(pa.array(by_length[x.shape[1]])).combine_chunks()
            score = _units(asks["own"].combine_chunks()) @ x.T
            edge = -np.partition(-score, most - 1, axis=1)[:, most - 1] if len(x) >= most else np.full(len(score), -np.inf)
            i, j = np.nonzero(score >= edge[:, None] - 1e-9)
            found.append((asks["query"].to_numpy()[i], part["rep"].to_numpy()[j]))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=["query", "rep"])

    return run


def _exact(entries: DataFrame, poor: DataFrame, most: int) -> DataFrame:
    """(query, rep): the ``most`` nearest of each query in each block of entries, all blocks of both in one job."""
    parts, chunks = (max(1, -(-df.count() // n)) for df, n in ((entries, EXACT_ENTRIES), (poor, EXACT_QUERIES)))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = entries.select("rep", "vec", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("part"), every(chunks, "chunk"))
    right = poor.select("query", "own", every(parts, "part"), F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int").alias("chunk"))
    return left.groupBy("part", "chunk").cogroup(right.groupBy("part", "chunk")).applyInArrow(_scan(most), "query long, rep long")


def cosine(a: str, b: str):
    """The cosine of two vectors in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, most: int = NEAREST, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the ``most`` nearest found of each row whose id is divisible by ``every``.

    score: the cosine of the original vectors in double precision; ties go to the smaller vec_id.
    Equal vectors are one entry of the index that keeps their ``most`` + 1 smallest ids, as no query
    needs more of them, so a very common vector is neither a large bucket nor a cap on what is found.
    A query whose buckets hold too few above its floor is compared with all entries, exactly, in blocks of
    both; without ``exact`` it has what was found.
    Rows whose vector is null, empty, zero or holds a null or non-finite component take no part, nor
    do null ids; vectors of other lengths are other spaces. A repeated id counts once per vector.
    Fewer candidates give fewer rows, no candidate or an empty table none.
    """
    spark, v = vectors.sparkSession, F.col(f"`{vector}`")
    clean = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(v, lambda x: F.when(x == 0, F.abs(x)).otherwise(x)).alias("vec")).where(F.col("id").isNotNull() & v.isNotNull()).where(F.coalesce(sound_of("vec"), F.lit(False)))
    # the smallest ids of each vector are chosen before and after the shuffle, so a common one is few rows there
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = clean.distinct().withColumn("n", place).where(F.col("n") <= most + 1)
    merged = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = written(merged.select(F.col("ids")[0].alias("rep"), "ids", "vec", F.xxhash64("vec").alias("same")), "entries")
    asking = written(clean.where(F.pmod("id", F.lit(every)) == 0).distinct().select("id", F.col("vec").alias("own"), F.xxhash64("vec").alias("same")), "asking")
    asking = written(asking.join(entries, "same").where(F.col("own") == F.col("vec")).select(F.col("id").alias("query_id"), F.col("rep").alias("query"), "own"), "queries")
    asks = written(asking.groupBy("query").agg(F.first("own").alias("own")), "asks")

    row = "bucket long, visit boolean, rep long, code binary, scale float, away float, floor double"
    drawn = entries.select("vec", F.xxhash64("rep", F.lit("sample")).alias("h")).where(F.pmod("h", F.lit(SAMPLE_PART)) == 0).orderBy("h").limit(SAMPLE)
    sample = [list(r["vec"]) for r in drawn.collect()]
    visits = asks.select(F.col("query").alias("rep"), F.col("own").alias("vec")).mapInArrow(_hash(True, sample, most + 1), row)
    hashed = written(entries.select("rep", "vec").mapInArrow(_hash(False), row).unionByName(visits), "hashed")
    large = written(hashed.where("not visit").groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1"), "large")
    dealt = hashed.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("rep", "bucket"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("visit"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own))).drop("parts")
    met = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "part").sortWithinPartitions("bucket", "part")
    found = met.mapInArrow(_search(most + 1), "query long, rep long, low double, high double").groupBy("query", "rep").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low"))))
    edge = F.max(F.when(F.col("n") == most + 1, F.col("low"))).over(Window.partitionBy("query"))
    pairs = ranked.withColumn("edge", edge).where("edge is null or high >= edge").select("query", "rep")

    def scored(p: DataFrame, tag: str) -> DataFrame:
        both = written(p.join(asks, "query"), f"{tag}-pairs").join(entries.select("rep", "ids", "vec"), "rep")
        return written(both.select("query", "rep", "ids", cosine("own", "vec").alias("score")), tag)

    known = scored(pairs, "scored")
    poor = asks.join(known.groupBy("query").agg(F.sum(F.size("ids")).alias("n")), "query", "left").where(F.coalesce("n", F.lit(0)) <= most).select("query", "own")
    if exact:
        poor = written(poor, "poor")
        if not poor.isEmpty():
            known = known.unionByName(scored(_exact(entries.select("rep", "vec"), poor, most + 1), "exact"))

    lists = known.dropDuplicates(["query", "rep"]).groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    flat = F.flatten(F.transform("near", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("s"), i.alias("i")))))
    lists = lists.select("query", F.array_sort(flat).alias("near"))
    answers = asking.join(lists, "query").select("query_id", F.posexplode(F.slice(F.filter("near", lambda n: n["i"] != F.col("query_id")), 1, most)).alias("pos", "n"))
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.i").alias("vec_id"), (-F.col("n.s")).alias("score"))


def sound_of(name: str):
    """Whether a vector has components, all of them finite numbers and one of them not zero."""
    bad = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(name) > 0) & ~bad & F.exists(name, lambda x: x != 0)

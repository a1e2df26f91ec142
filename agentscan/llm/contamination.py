"""Benchmark decontamination with an FM-index of each shard of training text.

A shard is a bounded run of documents in one task. Its words become symbols: the test phrases' own
words, and one separator for any run of other words and for a document's end. The shard's suffix
array gives the Burrows-Wheeler transform, kept as a wavelet matrix; all test phrases are searched
backward together through its ranks, each occurrence is located by walking to a sampled suffix
position, and the occurrences' spans are merged. Nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentscan.llm.common import discard, map_text, utf8, written
from agentscan.llm.words import words

WINDOW = 13
#: Words of test items that one pass over the documents searches for; more items take more passes.
BLOCK_WORDS = 500_000
#: Every so-many-th position of the shard keeps its place for locating, and so does each run's first.
SAMPLE = 8
#: Bytes of text of a shard at most, unless one document alone is longer.
SHARD_BYTES = 6_000_000


class Waveletmatrix:
    """Ranks of symbols in a sequence: one bit vector for each bit, counted at every position."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.n = bits, len(seq)
        self.ones, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            up = bit.astype(bool)
            seq = np.concatenate([seq[~up], seq[up]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        i, start = upto.copy(), np.zeros(len(upto), np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            ones, z = self.ones[level], self.zeros[level]
            i = np.where(one, z + ones[i], i - ones[i])
            start = np.where(one, z + ones[start], start - ones[start])
        return i - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        i, symbol = at.copy(), np.zeros(len(at), np.int64)
        for level in range(self.bits):
            ones, z = self.ones[level], self.zeros[level]
            one = ones[i + 1] > ones[i]
            symbol = symbol * 2 + one
            i = np.where(one, z + ones[i], i - ones[i])
        return symbol


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; separators (0) are all different, in order of position.

    The last symbol is a separator, so every suffix is told apart within its own run of words.
    """
    n = len(seq)
    sep = seq == 0
    start = seq.astype(np.int64) + int(sep.sum())
    start[sep] = np.arange(int(sep.sum()))
    wide = int(start.max()).bit_length()
    step = max(1, min(3, 62 // wide))
    key = np.zeros(n, np.int64)
    for j in range(step):
        key <<= wide
        key[: n - j] |= start[j:]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_ = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(open_):
        at = sa[open_]
        key = (rank[at] << 31) | rank[np.minimum(at + step, n - 1)]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[open_] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    return sa


class FMIndex:
    """Backward search and locating over a sequence that ends with a separator (0)."""

    def __init__(self, seq: np.ndarray, symbols: int):
        sa = suffix_array(seq)
        self.before = np.zeros(symbols + 2, np.int64)
        self.before[1:] = np.cumsum(np.bincount(seq, minlength=symbols + 1))
        self.bwt = Waveletmatrix(seq[sa - 1].astype(np.int64), max(1, int(symbols).bit_length()))
        kept = (sa % SAMPLE == 0) | (seq[sa - 1] == 0)
        self.kept, self.places = np.concatenate([[0], np.cumsum(kept)]), sa[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the index, from and to, whose suffixes begin with each phrase; rows of phrases end-aligned."""
        width = phrases.shape[1]
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.bwt.n, np.int64)
        for back in range(1, width + 1):
            go = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(go):
                break
            c = phrases[go, width - back].astype(np.int64)
            if back == 1:
                lo[go], hi[go] = self.before[c], self.before[c + 1]
            else:
                both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo[go], hi[go]]))
                lo[go], hi[go] = self.before[c] + both[: len(go)], self.before[c] + both[len(go) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in rows of the index."""
        place, steps, left, row = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(left):
            there = self.kept[row + 1] > self.kept[row]
            place[left[there]] = self.places[self.kept[row[there]]] + steps
            left, row = left[~there], row[~there]
            c = self.bwt.access(row)
            row = self.before[c] + self.bwt.rank(c, row)
            steps += 1
        return place


class Phrases:
    """The distinct windows of test items, as symbols of their own vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        raw = [(t or "").encode() for _, t in items]
        h, off = words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h).astype(np.int32) + 1
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        size = np.diff(off)
        some = np.flatnonzero(size > 0)
        per = np.maximum(size[some] - window, 0) + 1
        item = np.repeat(some, per)
        start = off[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
        length = np.minimum(size[item], window)
        # a row of the table is a window, its end aligned, with zeros before a short one
        back = np.arange(window) - window + length[:, None]
        table = np.where(back >= 0, ids[np.minimum(start[:, None] + back, len(ids) - 1)] if len(ids) else 0, 0).astype(np.int32)
        self.table, which = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        self.lengths = (self.table > 0).sum(1)
        # the items of each window, end to end
        pairs = np.unique(which.astype(np.int64).ravel() * max(1, len(self.names)) + np.array([number[items[i][0]] for i in item], np.int64))
        self.owner, first = pairs % max(1, len(self.names)), pairs // max(1, len(self.names))
        self.owner_at = np.searchsorted(first, np.arange(len(self.table) + 1))

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """0 for words of no test phrase."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def find(p: Phrases, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit words of a shard (bool each), and the documents and items of the pairs that occur."""
    hit, none = np.zeros(len(h), bool), np.zeros(0, np.int64)
    if not len(h) or not len(p.table):
        return hit, none, none
    sym = p.symbols(h)
    ends = np.zeros(len(h), bool)  # words before which another document begins
    ends[offsets[1:-1][offsets[1:-1] < len(h)]] = True
    known = sym > 0
    # a separator stands for each run of other words, and between known words of two documents
    gap = ~known & np.concatenate([[True], known[:-1]])
    extra = np.flatnonzero(ends & known & np.concatenate([[False], known[:-1]]))
    keep = np.flatnonzero(known | gap)
    place = np.concatenate([keep, extra])
    order = np.argsort(place * 2 + np.concatenate([np.ones(len(keep), np.int64), np.zeros(len(extra), np.int64)]), kind="stable")
    seq = np.concatenate([sym[keep], np.zeros(len(extra), np.int64), [0]])
    seq[:-1] = seq[:-1][order]
    place = place[order]
    index = FMIndex(seq, len(p.vocabulary))
    lo, hi = index.search(p.table, p.lengths)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    if not len(which):
        return hit, none, none
    rows = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = place[index.locate(rows)]
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + p.lengths[which], -1)
    hit = np.cumsum(change[:-1]) > 0
    doc = np.searchsorted(offsets, at, "right") - 1
    owners = (p.owner_at[1:] - p.owner_at[:-1])[which]
    items = p.owner[np.repeat(p.owner_at[which] - (np.cumsum(owners) - owners), owners) + np.arange(int(owners.sum()))]
    pairs = np.unique(np.repeat(doc, owners) * len(p.names) + items)
    return hit, pairs // len(p.names), pairs % len(p.names)


ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("first", "end", "from", "to")]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _batch(p: Phrases):
    def work(part: pa.RecordBatch) -> list[pa.Array]:
        data, text_off = utf8(part.column("__text__"))
        h, off = words(data, text_off)
        hit, docs, items = find(p, h, off)
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        starts = edge[:-1] == 1
        starts[off[:-1][np.diff(off) > 0]] |= hit[off[:-1][np.diff(off) > 0]]  # a span ends with its document
        first = np.flatnonzero(starts)
        last = np.concatenate([(edge[1:] == -1)])
        tail = off[1:][np.diff(off) > 0] - 1
        last[tail] |= hit[tail]
        end = np.flatnonzero(last) + 1
        doc = np.searchsorted(off, first, "right") - 1
        total = np.concatenate([[0], np.cumsum(hit)])
        lo, hi = first - off[doc], end - off[doc]
        begin, to = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
        for d in np.unique(doc):  # few documents have spans
            at = np.array([m.span() for m in _WORD.finditer(data[text_off[d] : text_off[d + 1]].tobytes())])
            mine = doc == d
            begin[mine], to[mine] = at[lo[mine], 0], at[hi[mine] - 1, 1]
        span = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (lo, hi, begin, to)], names=["first", "end", "from", "to"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, off).astype(np.int32)), span)
        names = pa.array(p.names, pa.string()).take(pa.array(items)) if len(items) else pa.array([], pa.string())
        found = pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(len(off))).astype(np.int32)), names)
        return [pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]]), spans, found]

    return work


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, spans and items: what any window of a test item covers.

    spans: the hit words as merged runs [first, end), from 0, with their bytes [from, to); items: ids, as strings, of the items
    with a window in the document, sorted. Null or empty texts, on either side, have no words and
    hit nothing; a null item id is the empty string. Repeated items count once, repeated documents
    each for itself. An empty table on either side gives no hits. Columns of ``docs`` with the
    added names are replaced.

    The items are read to the driver and broadcast in blocks of about BLOCK_WORDS words. One block, as
    of any usual benchmark, is one pass over the documents; each further one is a job of its own, whose
    rows are written before the next block is read, so that neither the driver nor a worker holds more
    than one block. Nothing is shuffled.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("t")).where(F.length("t") > 0).distinct()
    size = items.agg(F.sum(F.size(F.split("t", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_WORDS))
    cols = docs.columns if keep is None else keep
    found = docs
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()  # at most about BLOCK_WORDS words
        held = spark.sparkContext.broadcast(Phrases([(r["id"], r["t"]) for r in rows], window))
        got = map_text(found, text, ADDED, lambda held=held: _batch(held.value), None if blocks > 1 else cols, SHARD_BYTES)
        if blocks > 1:
            mine = F.struct("n_words", "spans", "items")
            last, found = found, written(got.withColumn("__all__", F.concat(F.col("__all__"), F.array(mine)) if b else F.array(mine)).drop(*ADDED.fieldNames()), f"items-{b}")
            held.unpersist()
            discard(last)
        else:
            found = got
    if blocks > 1:
        joined = lambda a, b: F.struct(a["first"].alias("first"), F.greatest(a["end"], b["end"]).alias("end"), a["from"].alias("from"), F.greatest(a["to"], b["to"]).alias("to"))
        covered = F.array_sort(F.flatten(F.transform("__all__", lambda x: x["spans"])))
        merged = F.aggregate(
            covered,
            F.array().cast("array<struct<first:int,end:int,from:int,to:int>>"),
            lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["first"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined(F.element_at(acc, -1), s)))).otherwise(
                F.concat(acc, F.array(s))
            ),
        )
        found = found.withColumns({"n_words": F.col("__all__")[0]["n_words"], "spans": merged, "items": F.array_sort(F.array_distinct(F.flatten(F.transform("__all__", lambda x: x["items"]))))})
        found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"]))
    return found.select(*[F.col(f"`{c}`") for c in cols if c not in ADDED.fieldNames()], *ADDED.fieldNames())


def without_spans(text: Column, spans: Column) -> Column:
    """A text without the bytes of its spans; one without spans is left as it is."""
    raw = text.cast("binary")
    begin = F.struct(F.lit("").cast("binary").alias("out"), F.lit(0).alias("at"))
    left = F.aggregate(
        spans,
        begin,
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(raw, acc["at"] + 1, s["from"] - acc["at"])).alias("out"), s["to"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(raw, acc["at"] + 1, F.octet_length(text))).cast("string"),
    )
    return F.when(F.size(spans) > 0, left).otherwise(text)


def contaminated(n_hit, n_words):
    """At least a twentieth of a document's words stand in windows of test items."""
    return (n_hit > 0) & (20 * n_hit >= n_words)

"""Which of many patterns may match a text, told by the literals that it holds: all literals in one pass.

A literal is looked for by its rarest run of three bytes. Runs of a batch of texts are hashed to 16 bits at
once and looked up; only where one of a literal begins are its bytes compared. So the work follows the
length of the texts, not the number of patterns, and no pattern that matches is left out.

The functions are told to Spark as non-deterministic, though they are not: filters that stand on a text's
flags, or after them, would else be moved before them, so that patterns are tried on every text and the
flags are made twice.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentscan.functions.needed import formula

#: Letters of prose by frequency, and bytes of text that are searched at once.
COMMON, PIECE = " etaoinsrhldcumfpgwybvk", 1 << 20
#: The column of marks made once for many detectors, and marks in one of its numbers.
SHARED, BITS = "__shared", 63
_FACTORS = (1, 251, 63_689)


def _hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return a * np.uint16(_FACTORS[0]) + b * np.uint16(_FACTORS[1]) + c * np.uint16(_FACTORS[2])


def _rare(word: bytes) -> int:
    """Where a literal's rarest run of three bytes begins."""
    cost = [max(0, 24 - COMMON.find(chr(x))) if chr(x) in COMMON else 0 for x in word]
    return min(range(len(word) - 2), key=lambda i: sum(cost[i : i + 3]))


class Finder:
    """Literals (lower case) in the order given; ``rows(texts)`` tells for each which texts hold it."""

    def __init__(self, words: Iterable[str]):
        self.words = [w.encode() for w in words]
        self.long = [i for i, w in enumerate(self.words) if len(w) > 2]
        self.at = {i: _rare(self.words[i]) for i in self.long}
        runs = np.array([list(self.words[i][self.at[i] : self.at[i] + 3]) for i in self.long], dtype=np.uint16).reshape(-1, 3)
        self.codes = _hash(runs[:, 0], runs[:, 1], runs[:, 2])
        self.known = np.zeros(1 << 16, dtype=bool)
        self.known[self.codes] = True

    def rows(self, texts: list[bytes]) -> np.ndarray:
        """A flag for each literal and text."""
        out = np.zeros((len(self.words), len(texts)), dtype=bool)
        first = 0
        while first < len(texts):
            last, size = first + 1, len(texts[first])
            while last < len(texts) and size + len(texts[last]) < PIECE:
                size += len(texts[last])
                last += 1
            self._piece(texts[first:last], out[:, first:last])
            first = last
        return out

    def _piece(self, texts: list[bytes], out: np.ndarray) -> None:
        # 255 stands in no text, so no literal is found across two of them; the end leaves room to compare
        whole = b"\xff".join(texts).lower()
        ends = np.cumsum([len(t) + 1 for t in texts])
        low = np.frombuffer(whole + b"\xff" * 256, dtype=np.uint8)
        wide = low[: len(whole) + 2].astype(np.uint16)
        code = _hash(wide[:-2], wide[1:-1], wide[2:])
        there = np.flatnonzero(self.known[code])
        order = np.argsort(code[there], kind="stable")
        there, code = there[order], code[there][order]
        left, right = np.searchsorted(code, self.codes, "left"), np.searchsorted(code, self.codes, "right")
        for k, i in enumerate(self.long):
            w, spot = self.words[i], there[left[k] : right[k]] - self.at[i]
            spot = spot[(spot >= 0) & (spot + len(w) <= len(whole))]
            for j, byte in enumerate(w):
                if not len(spot):
                    break
                spot = spot[low[spot + j] == byte]
            out[i, np.searchsorted(ends, spot, "right")] = True
        if short := [i for i, w in enumerate(self.words) if len(w) < 3]:
            lowered = [t.lower() for t in texts]
            for i in short:
                out[i] = [self.words[i] in t for t in lowered]


@functools.cache
def _plan(patterns: tuple) -> tuple[Finder, dict[str, int], tuple]:
    asked = tuple(formula(p) if isinstance(p, str) else (frozenset(p),) for p in patterns)
    words = sorted({w for parts in asked for w in _words(parts)})
    return Finder(words), {w: i for i, w in enumerate(words)}, asked


def _words(parts: Iterable) -> Iterator[str]:
    for p in parts:
        yield from p if isinstance(p, frozenset) else (w for one in p for w in _words(one))


def _holds(parts: tuple, held: np.ndarray, place: dict[str, int]) -> np.ndarray:
    """A flag for each text: whether it holds all parts of a formula."""
    out = np.ones(held.shape[1], dtype=bool)
    for p in parts:
        if isinstance(p, frozenset):
            out &= held[[place[w] for w in p]].any(axis=0)
        else:
            out &= np.logical_or.reduce([_holds(one, held, place) for one in p])
    return out


def flags(texts: pa.Array, patterns: tuple) -> np.ndarray:
    """A flag for each text and pattern: false where the pattern can't match. A null text holds nothing.

    A tuple of lower-case literals in a pattern's place is held by a text that holds one of them.
    """
    finder, place, asked = _plan(patterns)
    held = finder.rows([t or b"" for t in texts.cast(pa.large_binary()).to_pylist()])
    return np.stack([_holds(parts, held, place) for parts in asked], axis=1)


def held(text: Column | str, words: Iterable[str]) -> Column:
    """An array of a flag for each lower-case literal: whether the text, in lower case, holds it."""
    every = tuple(words)

    @F.arrow_udf("array<boolean>")
    def told(texts: pa.Array) -> pa.Array:
        return _rows(_finder(every).rows([t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]).T)

    return told.asNondeterministic()(text)


def some_held(text: Column | str, words: Iterable[str]) -> Column:
    """Whether the text, in lower case, holds one of the lower-case literals."""
    every = tuple(words)

    @F.arrow_udf("boolean")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array(_finder(every).rows([t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]).any(axis=0))

    return told.asNondeterministic()(text)


@functools.cache
def _finder(words: tuple[str, ...]) -> Finder:
    return Finder(words)


def _rows(found: np.ndarray) -> pa.Array:
    ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(found).ravel()))


def may(text: Column | str, patterns: Iterable[str]) -> Column:
    """An array of a flag for each pattern: false where the text lacks a literal of which every match holds one."""
    every = tuple(patterns)

    @F.arrow_udf("array<boolean>")
    def marked(texts: pa.Array) -> pa.Array:
        return _rows(flags(texts, every))

    return marked.asNondeterministic()(text)


def _packed(found: np.ndarray) -> pa.Array:
    """Rows of flags as arrays of numbers, ``BITS`` flags each."""
    n, width = len(found), -(-found.shape[1] // BITS)
    wide = np.zeros((n, width * BITS), dtype=bool)
    wide[:, : found.shape[1]] = found
    bits = np.concatenate([wide.reshape(n, width, BITS), np.zeros((n, width, 64 - BITS), dtype=bool)], axis=2)
    numbers = np.packbits(bits, axis=2, bitorder="little").view("<i8").ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(numbers))


def shared(df: DataFrame, text: str, items: Iterable) -> DataFrame:
    """``df`` with the marks of all patterns and tuples of literals in one column, which names them: ``marks`` and ``holding`` read them there."""
    every = tuple(dict.fromkeys(items))

    @F.arrow_udf("array<bigint>")
    def marked(texts: pa.Array) -> pa.Array:
        return _packed(flags(texts, every))

    return df.select("*", marked.asNondeterministic()(text).alias(SHARED, metadata={"text": text, "items": [json.dumps(x) for x in every]}))


def _known(df: DataFrame, text: str) -> dict:
    """Places of the marks that a frame's texts have already."""
    if SHARED not in df.columns or (of := df.schema[SHARED].metadata).get("text") != text:
        return {}
    items = [json.loads(x) for x in of["items"]]
    return {x if isinstance(x, str) else tuple(x): i for i, x in enumerate(items)}


def _bit(i: int) -> str:
    return f"(`{SHARED}`[{i // BITS}] & {1 << i % BITS}L) <> 0"


def marks(df: DataFrame, text: str, patterns: Iterable[str]) -> Column:
    """``may`` of a frame's texts, read from its shared marks where they hold all the patterns."""
    every, known = tuple(patterns), _known(df, text)
    if all(p in known for p in every):
        return F.expr(f"array({', '.join(_bit(known[p]) for p in every)})")
    return may(F.col(text), every)


def holding(df: DataFrame, text: str, words: Iterable[str]) -> DataFrame:
    """The rows whose text holds one of the lower-case literals."""
    every = tuple(words)
    known = _known(df, text)
    return df.where(F.expr(_bit(known[every])) if every in known else some_held(F.col(text), every))

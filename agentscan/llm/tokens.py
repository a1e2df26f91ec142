"""Token counts of a sentence-piece BPE vocabulary, with a shortcut for whole tokens.

A space becomes the vocabulary's word mark, and no piece of the vocabulary holds a mark after another
character or a line break, so nothing is ever merged across those places: a text's count is the sum of
the counts of its pre-tokens, runs of marks with the word that follows. Which pieces encode alone as
one token is proved once, offline, for the whole vocabulary; a pre-token that is such a piece counts
one, and only the others are merged.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentscan.llm.common import map_text, utf8

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Merged pre-tokens that a worker remembers at most; then it forgets them all and starts again.
REMEMBER = 300_000
#: Characters of a pre-token above which its count isn't remembered.
LONG = 64

MARK = "▁"


def vocabulary_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits(model) -> bool:
    """Whether the vocabulary lets texts be cut before runs of marks and around line breaks."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and model.encode("a\nb", out_type=str)[1:2] == ["<0x0A>"]


def proved(model) -> frozenset[str]:
    """Pieces, with the mark as a space, that are one token when they are encoded alone.

    Pieces that begin with a mark are encoded without it, as the library adds one to every text; the
    others after a line break, which costs two tokens and merges with nothing.
    """
    out = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        s = p.replace(MARK, " ")
        got = model.encode(s[1:]) if s[:1] == " " else model.encode("\n" + s)[2:]
        if got == [i]:
            out.append(s)
    return frozenset(out)


class Counts(dict):
    """Token counts of pre-tokens: proved pieces are one, others are merged when first seen."""

    def __init__(self, model, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole | {" "}, 1))  # a mark alone is a piece of one character
        self.model, self.whole, self.merged = model, frozenset(self), 0

    def __missing__(self, token: str) -> int:
        n = len(self.model.encode(token[1:])) if token[:1] == " " else len(self.model.encode("\n" + token)) - 2
        if len(token) <= LONG:
            self.merged += 1
            if self.merged > REMEMBER:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
                self.merged = 0
            self[token] = n
        return n


#: Pre-tokens within a line: spaces and the word after them.
PRE = re.compile(r" *[^ ]+| +")


def count(text: str, counts: Counts) -> int:
    """Tokens of a whole text; an empty one has none.

    The library reads a literal mark as a space and puts a mark before the text. A word with one space
    before it is the usual case and is cut out by split alone.
    """
    if not text:
        return 0
    text = " " + text.replace(MARK, " ")
    total = 0
    for i, line in enumerate(text.split("\n")):
        total += i > 0  # the line break
        if "  " in line or line[-1:] == " ":
            total += sum(map(counts.__getitem__, PRE.findall(line)))
        elif line:
            head, *rest = line.split(" ")
            if head:
                total += counts[head]
            total += sum([counts[" " + w] for w in rest])
    return total


ADDED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


#: A worker's counts by vocabulary file, kept from task to task.
_HELD: dict[str, Counts] = {}


def _count(path: str, whole: frozenset[str], limit: int):
    if path not in _HELD:
        _HELD[path] = Counts(load(path), whole)
    counts = _HELD[path]

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        _, off = utf8(part.column("__text__"))
        n = np.array([count(t or "", counts) for t in part.column("__text__").to_pylist()], np.int64)
        return [pa.array(np.diff(off)), pa.array(n, pa.int64()), pa.array(n > limit)]

    return work


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    ``path`` names the vocabulary file on every machine. A null text is empty: no bytes, no tokens.
    Whole texts of any length are counted; equal texts get equal counts. Columns of ``docs`` with the
    added names are replaced. A vocabulary that merges across spaces or line breaks is refused.
    """
    model = load(path)
    if not splits(model):
        raise ValueError(f"{path}: pieces cross spaces or line breaks, so pre-tokens can't be counted alone")
    held = docs.sparkSession.sparkContext.broadcast(proved(model))  # at most the vocabulary
    cols = docs.columns if keep is None else keep
    return map_text(docs, text, ADDED, lambda: _count(path, held.value, limit), cols).select(*[F.col(f"`{c}`") for c in cols if c not in ADDED.fieldNames()], *ADDED.fieldNames())

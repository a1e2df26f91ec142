"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes from both ends, gives every position a probability
for each language, and a document's probabilities are the means over all its positions. It is trained
in numpy by backpropagation through time on a bounded sample of labelled documents; scoring is a
projection over the documents, batch by batch.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentscan.llm.common import map_text, utf8

HIDDEN = 8
#: Bytes of a window; the state starts anew in each, so that windows of all texts run side by side.
WINDOW = 128
#: Windows that run side by side.
LANES = 1024
#: Labelled documents of the training sample at most, and pieces drawn from anywhere in each.
SAMPLE_DOCS, PIECES = 3000, 24
STEPS, BATCH, SPAN, RATE = 320, 192, 48, 0.02
#: Under this pooled probability a document counts as being in no known language: less than all others together.
FLOOR = 0.5


class Network:
    """Two gated recurrent layers, one for each direction, and a softmax over both states."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, h, n = languages, HIDDEN, len(languages)
        f = np.float32
        self.w = {}
        for d in "fb":
            for gate in "urc":  # update, reset, candidate
                self.w[f"x{gate}{d}"] = rng.normal(0, 0.3, (256, h)).astype(f)  # a byte's input and the bias
                self.w[f"r{gate}{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, h)).astype(f)
            self.w[f"o{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, n)).astype(f)
        self.w["b"] = np.zeros(n, f)

    def _states(self, d: str, seq: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each of the steps (steps x lanes x hidden) of bytes (steps x lanes), in reading order.

        Gates are hard logistic functions: a quarter of their input and a half, cut to 0 to 1. Each
        gate has arrays of its own, so that all of them are contiguous.
        """
        x, r = ({g: self.w[f"{k}{g}{d}"] * (1 if g == "c" else 0.25) for g in "urc"} for k in "xr")
        x["u"], x["r"] = x["u"] + np.float32(0.5), x["r"] + np.float32(0.5)
        state = np.zeros((seq.shape[1], HIDDEN), x["c"].dtype)
        out = np.empty((*seq.shape, HIDDEN), state.dtype)
        for t, at in enumerate(seq):
            gate = {}
            for g in "ur":
                v = x[g].take(at, 0)
                v += state @ r[g]
                gate[g] = np.clip(v, 0, 1, out=v)
            rec = state @ r["c"]
            cand = gate["r"] * rec
            cand += x["c"].take(at, 0)
            np.tanh(cand, out=cand)
            if trace is not None:
                trace.append((state, gate["u"], gate["r"], rec, cand))
                new = cand - state
            else:
                new = np.subtract(cand, state, out=cand)
            new *= gate["u"]
            new += state
            out[t] = state = new
        return out

    def probabilities(self, seq: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every position (steps x lanes x languages)."""
        f, b = self._states("f", seq), self._states("b", seq[::-1])[::-1]
        z = f @ self.w["of"] + b @ self.w["ob"] + self.w["b"]
        z -= z.max(2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(2, keepdims=True)
        return z

    def gradients(self, seq: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of all positions of windows (steps x lanes), and its gradients."""
        h, steps, lanes = HIDDEN, len(seq), seq.shape[1]
        tf, tb = [], []
        f, b = self._states("f", seq, tf), self._states("b", seq[::-1], tb)
        z = f @ self.w["of"] + b[::-1] @ self.w["ob"] + self.w["b"]
        z -= z.max(2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(2, keepdims=True)
        loss = float(-np.log(p[:, np.arange(lanes), labels] + 1e-9).mean())
        dz = p
        dz[:, np.arange(lanes), labels] -= 1
        dz /= steps * lanes
        g = {"of": np.einsum("tlh,tln->hn", f, dz), "ob": np.einsum("tlh,tln->hn", b[::-1], dz), "b": dz.sum((0, 1))}
        for d, trace, order, dout in (("f", tf, seq, dz @ self.w["of"].T), ("b", tb, seq[::-1], (dz @ self.w["ob"].T)[::-1])):
            r = {gate: self.w[f"r{gate}{d}"] for gate in "urc"}
            into = {gate: np.empty((steps, lanes, h), f.dtype) for gate in "urc"}
            dr = {gate: np.zeros_like(v) for gate, v in r.items()}
            carry = np.zeros((lanes, h), f.dtype)
            for t in range(steps - 1, -1, -1):
                state, update, reset, rec, cand = trace[t]
                ds = dout[t] + carry
                into["c"][t] = dcand = ds * update * (1 - cand * cand)
                into["u"][t] = ds * (cand - state) * (0.25 * ((update > 0) & (update < 1)))
                into["r"][t] = dcand * rec * (0.25 * ((reset > 0) & (reset < 1)))
                back = {"u": into["u"][t], "r": into["r"][t], "c": dcand * reset}
                carry = ds * (1 - update)
                for gate, v in back.items():
                    dr[gate] += state.T @ v
                    carry += v @ r[gate].T
            for gate in "urc":
                g[f"r{gate}{d}"] = dr[gate]
                g[f"x{gate}{d}"] = np.zeros_like(self.w[f"x{gate}{d}"])
                np.add.at(g[f"x{gate}{d}"], order.ravel(), into[gate].reshape(-1, h))
        return loss, g

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 11) -> None:
        """Adam steps on windows drawn from the pieces, each language as often as the others."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        by = [x for x in by if len(x)]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, STEPS + 1):
            docs = np.array([rng.choice(by[i % len(by)]) for i in range(BATCH)])
            seq = np.full((SPAN, BATCH), 32, np.int64)
            for lane, d in enumerate(docs):
                at = int(rng.integers(0, max(1, len(texts[d]) - SPAN + 1)))
                x = np.frombuffer(texts[d], np.uint8)[at : at + SPAN]
                seq[: len(x), lane] = x
            _, g = self.gradients(seq, labels[docs])
            rate = RATE * min(1, 4 * (1 - step / (STEPS + 1)))
            for k in self.w:
                m[k] += 0.1 * (g[k] - m[k])
                v2[k] += 0.01 * (g[k] * g[k] - v2[k])
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text (texts x languages); zeros for an empty one.

        Every byte of every text is read, in windows of WINDOW bytes; windows of about equal length
        run together.
        """
        n = np.diff(offsets)
        count = -(-n // WINDOW)
        doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(n[doc] - k * WINDOW, WINDOW)
        start = offsets[:-1][doc] + k * WINDOW
        order = np.argsort(-size, kind="stable")
        total = np.zeros((len(n), len(self.languages)))
        for a in range(0, len(order), LANES):
            lanes = order[a : a + LANES]
            steps = int(size[lanes[0]])
            at = start[lanes][None, :] + np.arange(steps)[:, None]
            inside = np.arange(steps)[:, None] < size[lanes][None, :]
            seq = np.where(inside, data[np.minimum(at, len(data) - 1)], 32).astype(np.intp)
            p = self.probabilities(seq)
            if not inside.all():
                p *= inside[:, :, None]
            np.add.at(total, doc[lanes], p.sum(0, dtype=np.float64))
        return total / np.maximum(n, 1)[:, None]


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; 0 is held out. A null key is held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 5, F.lit(0))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network fitted on at most SAMPLE_DOCS labelled documents outside the held-out fold.

    The sample is drawn by a hash of key and text, the same at any partitioning;
    None if no document has a label and a letter.
    """
    body = F.col(f"`{text}`")
    held = docs.select(F.col(f"`{key}`").alias("k"), body.alias("t"), F.col(f"`{lang}`").cast("string").alias("l"))
    n = held.where(F.col("l").isNotNull() & (fold(F.col("k")) != 0)).count()
    share = min(1.0, 1.2 * SAMPLE_DOCS / max(n, 1))
    room = F.greatest(F.length("t") - SPAN, F.lit(0)) + 1
    pieces = F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda i: F.substring("t", F.pmod(F.xxhash64("h", i), room).cast("int") + 1, F.lit(SPAN)))
    drawn = held.withColumn("h", F.xxhash64("k", "t")).where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30)))  # some SAMPLE_DOCS rows, so few leave each task
    rows = drawn.where(F.col("l").isNotNull() & (fold(F.col("k")) != 0) & F.col("t").rlike("\\p{L}")).select("l", "h", F.array_distinct(pieces).alias("pieces")).orderBy("h", "l", "pieces").limit(SAMPLE_DOCS).collect()
    if not rows:
        return None
    languages = sorted({r["l"] for r in rows})
    net = Network(languages)
    drawn = [(p.encode(), languages.index(r["l"])) for r in rows for p in r["pieces"] if p]
    net.fit([p for p, _ in drawn], np.array([k for _, k in drawn]))
    return net


ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def _label(net: Network | None):
    def work(part: pa.RecordBatch) -> list[pa.Array]:
        data, off = utf8(part.column("__text__"))
        letter = part.column("__letter__").to_numpy(zero_copy_only=False).astype(bool)
        if net is None:
            return [pa.array(["und"] * len(letter)), pa.array(np.zeros(len(letter)))]
        p = net.pooled(data, off)
        best = p.argmax(1)
        names = [net.languages[b] if x else "und" for b, x in zip(best, letter, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(letter, np.minimum(p.max(1), 1.0), 0.0))]

    return work


def identify(docs: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` with lang_pred and score, the pooled probability of that language.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing
    could be learned. Every byte counts; equal texts get equal results. Columns of ``docs`` with the
    added names are replaced.
    """
    letter = F.coalesce(F.col(f"`{text}`").rlike("\\p{L}"), F.lit(False))
    cols = [c for c in (docs.columns if keep is None else keep) if c not in ADDED.fieldNames()]
    with_letter = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").alias("__body__"), letter.alias("__letter__"))
    held = docs.sparkSession.sparkContext.broadcast(net)
    out = map_text(with_letter, "__body__", ADDED, lambda: _label(held.value), [*cols, "__letter__"])
    return out.select(*[F.col(f"`{c}`") for c in cols], *ADDED.fieldNames())


def crc_fold(doc_id: int) -> int:
    """The fold of a key, in Python."""
    return zlib.crc32(str(doc_id).encode()) % 5

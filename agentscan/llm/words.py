"""Words of many texts at once, as 64-bit hashes, with numpy over their UTF-8 bytes.

A word is a longest run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z: ASCII
letters and digits and every character beyond ASCII. In UTF-8 these are exactly the bytes
0-9, a-z and 0x80-0xFF, so whole batches need no decoding.
"""

from __future__ import annotations

import numpy as np

#: Byte to its lower-case form in a word, or 0 where a word ends.
LOWER = np.zeros(256, np.uint8)
LOWER[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
LOWER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
LOWER[128:] = np.arange(128, 256)

SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse modulo 2**64 to the powers 0 to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n, SEGMENT) + 1
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _segment(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and hashes of one segment; ``cuts`` are offsets in it where a text begins."""
    low = LOWER[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * up[: len(data)], out=sums[1:])
    return s, mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the offsets of each text's words.

    Works through segments that end between words, so memory stays bounded for a text of any length.
    """
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data):  # not inside a word: the next byte that ends one, or a text's beginning
            gap = np.flatnonzero(LOWER[data[end : end + 4096]] == 0)
            cut = offsets[np.searchsorted(offsets, end)]
            stop = min(end + (int(gap[0]) if len(gap) else 4096), int(cut))
            found = len(gap) > 0 or cut <= end + 4096
            end = stop
            if found:
                break
        lo, hi = np.searchsorted(offsets, at), np.searchsorted(offsets, end)
        s, h = _segment(data[at:end], offsets[lo:hi] - at)
        starts.append(s + at)
        hashes.append(h)
        at = end
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return h, np.searchsorted(s, offsets)


def shingles(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words of each text; a text of fewer, but some, words is one run."""
    n = np.diff(offsets)
    per = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.concatenate([[0], np.cumsum(per)])
    full = h.copy()
    for j in range(1, k):
        full[: len(h) - j] = full[: len(h) - j] * np.uint64(0xA0761D6478BD642F) + h[j:]
    which = np.repeat(np.arange(len(n)), per)
    at = offsets[:-1][which] + (np.arange(out[-1]) - out[:-1][which])
    made = mix(full[at] + np.uint64(k)) if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    v = n[short].astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)
    for j in range(k - 1):
        more = n[short] > j
        v[more] = v[more] * np.uint64(0xA0761D6478BD642F) + h[offsets[short[more]] + j]
    made[out[short]] = mix(v)
    return made, out

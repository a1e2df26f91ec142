"""Winnowing against a plain version, its guarantee, and edited neighbours."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentscan.llm import fingerprints as fp
from agentscan.llm.fingerprints import edited_neighbours, entries, likeness, read_back, winnow, written_as


def plain(text):
    """Kept (position, hash) by looking at every window."""
    if not text:
        return []
    k = min(fp.GRAM, len(text))
    hashes = []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * fp.BASE + ord(c)) % 2**64
        hashes.append(h * fp.SPREAD % 2**64 >> 16)
    w = min(fp.WINDOW, len(hashes))
    kept = set()
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        kept.add((max(j for j in range(i, i + w) if hashes[j] == least), least))
    return sorted(kept)


def drawn(r, n, letters="abcdefgh é中𝒳\n"):
    return "".join(r.choice(letters) for _ in range(n))


TEXTS = ["", "a", "ab" * 5, "x" * 11, "x" * 12, "x" * 500, "ab" * 300] + [drawn(random.Random(n), n) for n in (5, 11, 12, 13, 42, 43, 44, 45, 100, 1000)]


@pytest.mark.parametrize("text", TEXTS)
def test_against_all_windows(text):
    hashes, places = winnow(text)
    assert list(zip(places.tolist(), hashes.tolist(), strict=True)) == plain(text)
    back = read_back(written_as(hashes, places))
    assert (back[0] == hashes).all() and (back[1] == places).all()


def test_pieces_of_a_long_text(monkeypatch):
    text = drawn(random.Random(1), 3000) + "y" * 700 + drawn(random.Random(2), 900)
    want = plain(text)
    for piece in (1, 64, 1000, 1 << 15):
        monkeypatch.setattr(fp, "PIECE", piece)
        hashes, places = winnow(text)
        assert list(zip(places.tolist(), hashes.tolist(), strict=True)) == want


def test_every_shared_passage_is_found():
    """A passage of GRAM + WINDOW - 1 code points has a kept hash at the same place in both texts."""
    r = random.Random(3)
    for _ in range(60):
        passage = drawn(r, fp.GRAM + fp.WINDOW - 1, "ab")
        at = r.randrange(200), r.randrange(200)
        found = []
        for a in at:
            hashes, places = winnow(drawn(r, a, "ab") + passage + drawn(r, r.randrange(200), "ab"))
            inside = (places >= a) & (places <= a + fp.WINDOW - 1)
            found.append(set(zip(hashes[inside].tolist(), (places[inside] - a).tolist(), strict=True)))
        assert found[0] & found[1]


def test_entries_of_a_column(spark):
    text = drawn(random.Random(5), 400)
    rows = spark.createDataFrame([(1, text, "old"), (2, None, "old"), (3, text, "old")], "doc_id long, text string, fingerprint string")
    got = fp.fingerprints(rows).select("doc_id", "fingerprint", entries(F.col("fingerprint")).alias("e")).orderBy("doc_id").collect()
    assert got[0].fingerprint == got[2].fingerprint and got[1].fingerprint == "" and got[1].e == []
    assert [(x.position, int(x.hash, 16)) for x in got[0].e] == plain(text)


def expected(rows):
    ordered = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = []
    for i, (key, text) in enumerate(ordered):
        own, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        m = len(own) // 3
        edited = own[: len(own) - m] + following[:m]
        a, b, c = ({h for _, h in plain(t)} for t in (own, edited, following))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((key, len(own), hashlib.sha256(edited.encode()).hexdigest(), written_as(*winnow(own)), written_as(*winnow(edited)), like(a, b), like(a, c)))
    return out


def test_neighbours_against_plain(spark):
    r = random.Random(7)
    shared = drawn(r, 300)
    rows = [(i * 3 - 100, r.choice([drawn(r, r.randrange(200)), shared, shared + drawn(r, 9), None, "", "z"])) for i in range(150)] + [(None, "null key " + shared)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, fingerprint string, part int")
    for n in ("1", "4", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = edited_neighbours(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(map(tuple, got), key=str) == sorted(expected(rows), key=str)


def test_ties_and_repeats_are_one_ring(spark):
    rows = [(5, "five one"), (5, "five two"), (5, "five two"), (9, "nine"), (None, None), (None, "none")] * 2
    got = edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(x.doc_id), x.n_chars) for x in got) == sorted((str(k), len(t or "")) for k, t in rows)
    again = edited_neighbours(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_single_and_empty(spark):
    one = edited_neighbours(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [(x.doc_id, x.n_chars, x.near_edited, x.near_next, x.edited_sha256) for x in one] == [(1, 6, 0.0, 1.0, hashlib.sha256(b"abcdab").hexdigest())]
    assert edited_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert likeness(np.zeros(0), np.zeros(0)) == 1.0 and likeness(np.zeros(0), np.ones(1)) == 0.0


def test_text_keys_and_a_very_long_text(spark):
    long = drawn(random.Random(9), 200_000)
    got = edited_neighbours(spark.createDataFrame([("b", long), ("é", "short"), ("a", long[:100_000])], "doc_id string, text string")).collect()
    assert {x.doc_id: x.n_chars for x in got} == {"b": 200_000, "é": 5, "a": 100_000}
    assert abs({x.doc_id: x.near_next for x in got}["b"] - 0.5) < 0.02

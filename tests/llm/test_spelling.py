"""PartEnum signatures and spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from agentscan.llm import registry, spelling
from agentscan.llm.spelling import near_words, signatures, spelling_variants, word_counts


def counted(rows, at_least=6, often=5):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    return {w: k for w, k in n.items() if len(w) >= at_least and k >= often}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n):
    near = {w: [o for o in n if abs(len(o) - len(w)) <= 1 and one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made(seed, count=1500):
    """Words with slips of up to three letters, in counts that make chains, and some pathological ones."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéü"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 11))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * r.choice([700, 150, 30])
        for steps in (1, 2, 3):
            v = list(w)
            for _ in range(steps):
                i = r.randrange(len(v))
                v[i : i + 1] = r.choice([[], [r.choice(letters)], [v[i], r.choice(letters)]])
            words += ["".join(v)] * r.choice([140, 30, 6, 5])
    words += ["".join(p) for p in (r.choices("ab", k=8) for _ in range(count))] * 2  # one multiset, many words
    r.shuffle(words)
    return words


def docs_of(spark, rows):
    return spark.createDataFrame([(*x, "clash", 0) for x in rows], "doc_id long, text string, word string, n int")


@pytest.mark.parametrize("bucket", [256, 3])
def test_variants_against_plain(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    words = made(bucket)
    rows = [(i if i % 50 else None, " ".join(w.upper() if k % 3 == 0 and w.isascii() else w for k, w in enumerate(words[i * 90 : i * 90 + 90])) + ", x_y 12") for i in range(len(words) // 90 + 1)]
    rows += [(7, None), (8, ""), (9, "ab cde " * 9), (10, "xyzzyÀÿ×" * 1), (10, "xyzzyÀÿ×"), (10, "xyzzyÀÿ×")] + [(10, "xyzzyÀÿ×")] * 4
    got = sorted(tuple(x) for x in spelling_variants(docs_of(spark, rows)).collect())
    want = expected(counted(rows))
    assert got == want
    assert any(w[2] not in (w[0], w[1]) for w in want) and len(want) > 300


def test_long_words(spark):
    long = "".join(random.Random(4).choices("abcdefgh", k=20_000))
    many = ["ab" * 31 + "c" * k + "d" for k in range(0, 6)] + ["ab" * 31 + "c" * k + "e" for k in range(0, 6)] + [long, long[1:], long[:-1] + "x", long[:9_000] + long[9_001:]]
    n = {w: 5 + 30 * (i % 3) for i, w in enumerate(many)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = sorted((a, b, n[b]) for a in n for b in n if abs(len(a) - len(b)) <= 1 and one_edit(a, b))
    for bucket in (256, 1):
        spelling.BUCKET, before = bucket, spelling.BUCKET
        try:
            assert sorted(tuple(x) for x in near_words(words).collect()) == want
        finally:
            spelling.BUCKET = before


@pytest.mark.parametrize("shape", [(1, 3), (1, 7), (2, 4), (3, 1)])
def test_every_partition_keeps_all_near_pairs(spark, shape):
    n = counted([(i, w) for i, w in enumerate(made(1, 100))], often=1)
    signed = signatures(spark.createDataFrame(list(n.items()), "word string, n long"), *shape).collect()
    held = {}
    for x in signed:
        held.setdefault(x.word, set()).add(x.signature)
    assert all(held[a] & held[b] for a in n for b in n if abs(len(a) - len(b)) <= 1 and one_edit(a, b))


def test_counts_and_empty(spark):
    rows = [(i, "Größeren naïve größeren") for i in range(300)]
    assert {x.word: x.n for x in word_counts(docs_of(spark, rows)).collect()} == counted(rows)
    none = docs_of(spark, rows).where("false")
    assert spelling_variants(none).count() == 0 and spelling_variants(none.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(x[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for x in registry.op11_spelling(spark, "/root/testdata/sf0.001").collect())
    assert got == expected(counted([tuple(x) for x in table]))

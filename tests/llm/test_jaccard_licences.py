"""Jaccard join and licence scan against brute force, with nulls, ties, repeats and long texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agentscan.llm import licences
from agentscan.llm.jaccard import components, jaccard_join, least_matches, minhash
from agentscan.llm.words import shingles, words


def split(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute(rows, k=5):
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set())
    links, par = Counter(), list(range(len(rows)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                par[root(a)] = root(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    ids = [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(rows))]
    return sorted(((rows[i][0], links[i], ids[i]) for i in range(len(rows))), key=str)


def test_join_finds_the_links_of_brute_force(spark):
    r = random.Random(5)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{r.randrange(900)}é" for _ in range(r.choice([3, 6, 40, 300]))]
        for _ in range(r.choice([1, 2, 9])):
            t = base[:]
            for _ in range(r.choice([0, 0, 1, 3, 10])):
                t[r.randrange(len(t))] = f"x{r.randrange(900)}"
            rows.append((n, " ".join(t).upper() if n % 3 else "\n".join(t)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "?!"), (None, rows[0][1]), (0, rows[0][1]), (0, "other words under the same number")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit("x"))
    got = sorted(((x.doc_id, x.n_links, x.class_id) for x in jaccard_join(df).collect()), key=str)
    assert got == brute(rows)
    assert jaccard_join(df.where("false")).count() == 0


def test_large_groups_are_met_block_by_block(spark, monkeypatch):
    from agentscan.llm import jaccard

    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(jaccard, "CLUSTER_BLOCK", 8)
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        t = base[:]
        t[r.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_links, x.class_id) for x in jaccard.jaccard_join(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("limit", [None, 600])
def test_repeated_rows_and_bytes_of_blocks(spark, monkeypatch, limit):
    from agentscan.llm import jaccard

    if limit:  # blocks by bytes
        monkeypatch.setattr(jaccard, "BLOCK_BYTES", limit)
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base))] * 50 + [(None, " ".join(base[:-1]))] * 40
    rows += [(2 + i, " ".join([*base[:i], "new", *base[i + 1 :]])) for i in range(0, 60, 7)] + [(90, " ".join(r.sample(base, 60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bytes", F.lit("x"))
    got = sorted(((x.doc_id, x.n_links, x.class_id) for x in jaccard.jaccard_join(df).collect()), key=str)
    assert got == brute(rows)


def test_chunks_of_texts_are_all_read():
    from agentscan.llm.jaccard import _sets

    parts = pa.chunked_array([pa.array(["a b c d e f", None]), pa.array([], pa.string()), pa.array(["a b c d e f", "x"])])
    sets = _sets(parts, 5)
    assert [len(s) for s in sets] == [2, 0, 2, 1] and (sets[0] == sets[2]).all()


def test_spark_ml_works_after_the_join(spark):
    from agentscan.operators.classifier import q_classifier

    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h")], "doc_id long, text string")
    assert jaccard_join(df).count() == 2
    assert q_classifier(spark, "/root/testdata/sf0.001").count() > 0


def test_minhash_estimates_similarity_and_pruning_keeps_true_pairs():
    data = np.frombuffer(b" ".join(b"w%d" % i for i in range(1000)) + b" ".join(b"w%d" % i for i in range(100, 1100)), np.uint8)
    cut = len(b" ".join(b"w%d" % i for i in range(1000)))
    sh, off = shingles(*words(data, np.array([0, cut, len(data)])), 5)
    s = minhash(sh, off)
    assert abs((s[0] == s[1]).mean() - 0.81) < 0.12
    assert least_matches(0.8, 1e-5)[-1] < 0.8 * 128


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100, 102: 100}


def licence_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_licences(texts):
    """Labels and score of each text by counting where a template would begin, all postings in turn."""
    split_ = [licence_words(t) for t in texts]
    df = Counter(w for ws in split_ for w in set(ws))
    known = {w for _, ks, t in licences.TEMPLATES for w in licence_words(" ".join([t, *ks]))} | {w for p, _ in licences.BASE for w in p.split()}
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) for w in known}
    stands = lambda ws, p: any(ws[j : j + len(p)] == p for j in range(len(ws)))
    out = []
    for ws in split_:
        labels, score = set(), 0.0
        for p, label in licences.BASE:
            if stands(ws, p.split()):
                labels.add(label)
                score = 1.0
        for label, ks, t in licences.TEMPLATES:
            tw = licence_words(t)
            listed = sorted({w for w in tw if df[w]}, key=lambda w: (-idf[w], tw.index(w)))[: licences.INDEXED]
            own = [w for w in listed if w in ws][: licences.RARE]
            begins = Counter(j - i for w in own for i, x in enumerate(tw) if x == w for j, y in enumerate(ws) if y == w)
            most = min(licences.RARE, len(listed))
            part = min(max(begins.values(), default=0), most) / most if most else 0.0
            if part >= licences.ALIGNED and all(stands(ws, k.split()) for k in ks):
                labels.add(label)
                score = max(score, part)
        out.append((",".join(sorted(labels)), round(score, 9)))
    return out


def test_licences_against_brute_force(spark):
    texts = [None, "", "Released under the MIT License.", "under THE mit license " * 3, "under the mit licence", "under the miT license", "cc-by-nc 4.0; CC BY NC", "Apache License, Version 2.0", "mit " * 5000, "é under the mit license ü"]
    texts += [t for _, _, t in licences.TEMPLATES] + ["Before it. " + t.upper() + " After it." for _, _, t in licences.TEMPLATES]
    r = random.Random(9)
    for _, _, t in licences.TEMPLATES:  # edited, cut and doubled notices
        w = t.split()
        w[r.randrange(len(w))] = "edited"
        texts += [" ".join(w), " ".join(w[: len(w) // 2]), t + " and again " + " ".join(w[1:])]
    texts += [" ".join(r.choice(["license", "software", "the", "public", "gnu", "free", "general", "warranty"]) for _ in range(60)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("w", F.lit(2)).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    want = brute_licences(texts)
    for i, t in enumerate(texts):
        w = licence_words(t)
        at = [(j, x) for p, x in licences.BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert (r.labels, round(r.score, 9)) == want[i], t
    for i, (label, _, _) in enumerate(licences.TEMPLATES):
        assert label in got[10 + i].labels.split(",") and label in got[10 + len(licences.TEMPLATES) + i].labels.split(",")
    assert got[0].score == 0 and licences.scan(df.where("false")).count() == 0


def test_labels_do_not_follow_the_corpus_share_of_licences(spark):
    notices = [t for _, _, t in licences.TEMPLATES]
    probes = notices + [" ".join(t.split()[:-1]) for t in notices] + ["A text about " + " ".join(t.split()[: len(t.split()) // 3]) for t in notices]

    def labels(others):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(probes + others)], "doc_id long, text string")
        return {r.doc_id: r.labels for r in licences.scan(df).where(F.col("doc_id") < len(probes)).collect()}

    assert labels(["Nothing of the kind stands here."] * 400) == labels([t + " Code follows." for t in notices] * 20)

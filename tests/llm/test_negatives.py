"""Kronecker-packed products and hard negatives, against plain integer arithmetic."""

import math
import random

import numpy as np
import pytest

from agentscan.llm import negatives, registry
from agentscan.llm.negatives import hard_negatives, of_blocks


@pytest.mark.parametrize("top", [0, 1, 3, 300, 10**6, 2**40, 2**62])
@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (130, 50, 64), (3, 4, 0)])
def test_packed_products_are_exact(top, shape):
    m, n, d = shape
    r = random.Random(top + m)
    draw = lambda k: np.array([[r.randint(-top, top) for _ in range(d)] for _ in range(k)], np.int64).reshape(k, d)
    a, c = draw(m), draw(n)
    if d:
        a[0], c[0], c[-1] = top, top, -top  # the largest products
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in c] for u in a]
    assert [[int(s) for s in row] for row in of_blocks(a, c)] == want


def brute(rows, positives=5, negatives=5, every=100, low=80, high=100):
    clean = set()
    for i, vec, label in rows:
        if i is not None and label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            clean.add((i, str(label), tuple(math.floor(256 * float(x)) for x in vec)))
    out = []
    for i, label, vec in clean:
        if i % every:
            continue
        others = [(-sum(x * y for x, y in zip(vec, v, strict=True)), j, lab) for j, lab, v in clean if j != i and len(v) == len(vec)]
        for s, j, _ in sorted(o for o in others if o[2] == label)[:positives]:
            fit = sorted((t, k) for t, k, lab in others if lab != label and low * -s <= -100 * t <= high * -s)
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(fit[:negatives])]
    return sorted(out)


def rows_of(found):
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


SCHEMA = "vec_id long, embedding array<double>, label int, id string, parts int"


def made(n, dim, labels, seed):
    r = random.Random(seed)
    return [(i, [r.gauss(0.3, 0.5) for _ in range(dim)], r.choice(labels)) for i in range(n)]


def test_against_brute_force_with_many_blocks(spark, monkeypatch):
    """Ties, repeats, a hot label, nulls, odd components, empty and zero vectors, other lengths, clashing names."""
    monkeypatch.setattr(negatives, "BLOCK", 90)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    rows = made(900, 6, [0, 1, 1, 1, 2], 1) + made(120, 3, [0, 1], 2)
    rows += rows[:40] + [(100, [0.5] * 6, 2), (200, [0.5] * 6, 1), (300, [0.5] * 6, 0)] + [(1000 + k, [0.5] * 6, k % 2) for k in range(30)]
    rows += [(None, [0.1] * 6, 1), (2000, None, 1), (2100, [0.1] * 6, None), (2200, [0.1, None] * 3, 1), (2300, [math.nan] * 6, 1), (2400, [math.inf] * 6, 0)]
    rows += [(2500, [0.0] * 6, 1), (2501, [0.0] * 6, 2), (2502, [0.0] * 6, 1), (2600, [], 1), (2601, [], 1), (2602, [], 0)]
    got = rows_of(hard_negatives(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)))
    assert got == brute(rows) and len(got) > 100


def test_wide_components(spark):
    """Python's integers; scores beyond a long keep their order and are null."""
    for scale in (1e6, 1e7):
        rows = [(i, [x * scale for x in v], k) for i, v, k in made(300, 5, [0, 1], 3)]
        fit = lambda s: s if s < 2**63 else None
        want = [(*r[:4], fit(r[4]), fit(r[5])) for r in brute(rows)]
        assert rows_of(hard_negatives(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))) == want


def test_few_and_none(spark):
    df = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert rows_of(hard_negatives(df([]))) == []
    assert rows_of(hard_negatives(df([(0, [1.0], 1)]))) == []
    assert rows_of(hard_negatives(df([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]))) == [(0, 1, 1, 2, 65536, 256 * 230)]


def test_query_relabels(spark):
    rows = [r for r in registry.op13_negatives(spark, "/root/testdata/sf0.001").collect()]
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    want = brute([(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table])
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows) == want and want


def test_sql_of_archives_with_null_ids(spark):
    """The archives' SQL with null page ids: a null id's page revisits the smallest, as in the query."""
    import duckdb

    from agentscan.llm import archives, oracles

    rows = [(None, "http://a/1", "x" * 200), (4, "http://a/2", "x" * 200), (7, "http://a/3", "x" * 200), (None, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = archives.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({oracles.OP2})").fetchall(), key=str)

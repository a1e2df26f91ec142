"""Candidates of nearest neighbours among many near copies of one vector."""

import numpy as np
import pyarrow as pa

from agentscan.llm import neighbours


def test_a_query_among_near_copies_keeps_few_candidates():
    """Codes of one byte could not tell near copies apart: each query kept the whole group, so rows grew with its square."""
    r = np.random.default_rng(4)
    centre = r.normal(size=64)
    x = centre + r.normal(size=(900, 64)) * 0.09
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, scale, away = neighbours.codes(x)
    raw = [c.tobytes() for c in code]
    asks = np.arange(0, 900, 50)
    rows = [(i, False) for i in range(900)] + [(i, True) for i in asks]
    at = [i for i, _ in rows]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * len(rows)), pa.array([v for _, v in rows]), pa.array(at), pa.array([raw[i] for i in at], pa.binary()), pa.array(scale[at]), pa.array(away[at]), pa.array([-2.0] * len(rows)), pa.array([0] * len(rows))],
        names=["bucket", "visit", "rep", "code", "scale", "away", "floor", "part"],
    )
    found = pa.Table.from_batches(list(neighbours._search(6)(iter([batch])))).to_pylist()
    assert len(found) < 10 * len(asks)
    for q in asks:
        assert set(np.argsort(-(x @ x[q]))[:6].tolist()) <= {f["rep"] for f in found if f["query"] == q}

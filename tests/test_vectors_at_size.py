"""The search over vectors: what it holds at once, and odd rows against brute force."""

import tracemalloc

import numpy as np
import pytest

from bipole.operators import represent


def brute(rows, k):
    ids = np.array([p for p, _ in rows])
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.array([v for _, v in rows], np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        u = np.where(n > 0, x / n, 0)  # one with a NaN counts as one of no length, one with an infinity has no cosine
    want = set()
    for q, v in zip(ids, u, strict=True):
        s = np.round((u * v).sum(1), 12)
        near = [(p, c) for _, p, c in sorted((2 if np.isnan(c) else -c, p, c) for p, c in zip(ids, s, strict=True) if p != q)][:k]
        want |= {(q, p, None if np.isnan(c) else float(c) + 0.0, r + 1) for r, (p, c) in enumerate(near)}
    return want


def test_a_task_holds_tiles_and_not_rows_of_all_cosines():
    rng = np.random.default_rng(3)
    y, u = represent._unit(rng.standard_normal((60_000, 8))), represent._unit(rng.standard_normal((700, 8)))
    best, ids, pos = represent.Best(700, 5), np.arange(700) + 59_900, np.arange(60_000)
    tracemalloc.start()
    represent._compare(best, ids, u, pos, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all cosines of 256 queries alone are 123 MB
    for i in (0, 150, 699):
        s = np.round(y @ u[i], 12)
        order = [j for j in np.lexsort((pos, -s)) if j != ids[i]][:5]
        assert best.pos[i].tolist() == order and np.allclose(best.keys[i], s[order], atol=1e-12)


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("limit", [7, 1 << 16])
def test_copies_and_odd_vectors(spark, kind, limit):
    rng = np.random.default_rng(8)
    rows = [(int(p), rng.integers(-2, 3, 4).astype(float).tolist()) for p in rng.permutation(70)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(20)] + [(200 + i, [0.0] * 4) for i in range(3)] + [(300 + i, [float("nan"), 1.0, 0.0, 0.0]) for i in range(2)] + [(310 + i, [float("inf"), 1.0, 0.0, 0.0]) for i in range(4)]
    frame = spark.createDataFrame([*rows, (None, [1.0, 1.0, 1.0, 1.0])], f"pos bigint, embedding array<{kind}>")
    for k in (3, 200):
        got = represent.nearest_vectors(frame.withColumnRenamed("pos", "query_id"), frame, k, limit=limit).collect()
        told = {(r[0], r[1], None if np.isnan(r[2]) else r[2] + 0.0, r[3]) for r in got}
        assert len(told) == len(got) and told == brute(rows, k)
    assert represent.nearest_vectors(frame.withColumnRenamed("pos", "query_id"), frame.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        represent.nearest_vectors(spark.createDataFrame([(1, [1.0])], "query_id bigint, embedding array<double>"), frame, 3).count()

"""K-means with heaps of bounds against the plain algorithm."""

import hashlib
import math

import numpy as np
import pytest

from inkstone.llm import centroids


def plain(rows, k, rounds, dim, seed="2"):
    kept = [(i, [math.floor(256 * x) for x in v], v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v, q) for i, q, v in kept)
    points = [q for _, _, q in named[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(q, p), c) for c, p in enumerate(points)) for _, q, _ in kept]
    for _ in range(rounds):
        own = assign()
        for c in range(len(points)):
            members = [q for (_, q, _), (_, at) in zip(kept, own) if at == c]
            if members:
                points[c] = [sum(x) // len(members) for x in zip(*members)]
    own = assign()
    inertia = {c: sum(d for d, at in own if at == c) for c in range(len(points))}
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(repr((i, c, d, inertia[c], sum(inertia.values()), sha[c])) for (i, _, _), (d, c) in zip(kept, own))


def vectors(seed=1, n=700, dim=8):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((9, dim)) * 2
    rows = [(k, (centre[k % 9] + rng.standard_normal(dim) * rng.choice([0.1, 1.0])).astype(np.float32).tolist()) for k in range(n)]
    rows += [(2000 + k, [0.5] * dim) for k in range(60)] + [(1, [0.25] * dim), (None, [-1.5] * dim)]
    # exact ties between centroids, and all that is left out
    rows += [(3000 + k, [float(k % 2)] + [0.0] * (dim - 1)) for k in range(20)]
    nan, inf = float("nan"), float("inf")
    return rows + [(4000, None), (4001, []), (4002, [1.0] * (dim + 1)), (4003, [nan] + [1.0] * (dim - 1)), (4004, [-inf] + [1.0] * (dim - 1)), (4005, [None] + [1.0] * (dim - 1))]


SCHEMA = "vec_id bigint, embedding array<float>, cluster string, id int"


@pytest.mark.parametrize("k,rounds,block", [(12, 5, 4096), (5, 3, 64), (1, 2, 64), (3, 0, 64)])
def test_clusters_equal_plain_version(spark, monkeypatch, k, rounds, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = vectors()
    table = spark.createDataFrame([(i, v, "c", 0) for i, v in rows], SCHEMA)
    found = centroids.cluster(table, k=k, rounds=rounds, dim=8)
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain(rows, k, rounds, 8)


def test_few_or_no_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], SCHEMA), dim=8).count() == 0
    rows = [(5, [1.0] * 8), (6, [2.0] * 8), (5, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, "c", 0) for i, v in rows], SCHEMA)
    assert sorted(repr(tuple(r)) for r in centroids.cluster(table, dim=8).collect()) == plain(rows, 40, 5, 8)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 8, "c", 0)], SCHEMA), dim=8).count()


@pytest.mark.parametrize("scale", [1, 1 << 24])
def test_heaps_skip_vectors_and_stay_exact(scale):
    """Blocks stepped by drifting centroids give what a full comparison gives, with few comparisons once little moves."""
    rng = np.random.default_rng(3)
    x = (rng.integers(-30, 30, (3000, 6)) + np.repeat(rng.integers(-200, 200, (10, 6)), 300, axis=0)) * scale // 8
    at = centroids.Places(x[rng.choice(3000, 10, replace=False)], np.zeros(10))
    block, total = centroids.Block.new(None, x, at)
    scanned = []
    for turn in range(6):
        own = np.empty(len(x), dtype=int)
        for c, heap in enumerate(block.heaps):
            own[[p for _, p in heap]] = c
        d = np.stack([((x.astype(object) - p) ** 2).sum(axis=1) for p in at.points.astype(object)], axis=1)
        assert np.array_equal(own, d.argmin(axis=1))
        assert np.array_equal(total, np.stack([np.append(x[own == c].sum(axis=0), (own == c).sum()) for c in range(10)]))
        points = at.points.copy()
        for c in range(10):
            if total[c, -1]:
                points[c] = total[c, :-1] // total[c, -1]
        at = at.moved(points)
        total = total + block.step(at)
        scanned.append(block.scanned)
    assert scanned[-1] < 1500

"""Centroid clustering against a plain loop in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from fixturelake.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, cells string, comps int"


def plain(rows, dims=64, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))  # noqa: E731, B905
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == c]  # noqa: B905
            centroids[c] = [sum(x) // len(members) for x in zip(*members)]  # noqa: B905
    last = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, far, c in last:
        inertia[c] = inertia.get(c, 0) + far
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, far, inertia[c], sum(inertia.values()), sha[c]) for i, far, c in last), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "x", 3) for i, v in rows], SCHEMA).repartition(3)


def as32(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def check(spark, rows, **more):
    rows = [(i, as32(v)) for i, v in rows]
    got = sorted((tuple(r) for r in vafile.clustered(frame(spark, rows), **more).collect()), key=str)
    assert got == plain(rows, **more)
    return got


def clouds(rng, n, dims=64):
    middles = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(9)]
    return [[x + rng.gauss(0, 0.1) for x in rng.choice(middles)] for _ in range(n)]


def test_clusters_of_clouds(spark):
    rng = random.Random(4)
    assert len({r[1] for r in check(spark, list(enumerate(clouds(rng, 400))))}) > 4


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(5)
    v = clouds(rng, 60)
    rows = list(enumerate(v)) + [(3, v[3]), (3, v[3]), (7, v[8]), (None, v[9]), (100, None), (101, v[0][:63]), (102, []), (103, [*v[0], 0.0])]
    rows += [(104, [None, *v[0][1:]]), (105, [float("nan"), *v[0][1:]]), (106, [float("inf"), *v[0][1:]]), *[(200 + i, v[5]) for i in range(150)]]
    check(spark, rows)


def test_ties_few_vectors_and_large_components(spark):
    same = [0.5] * 64
    check(spark, [(i, same) for i in range(30)])
    check(spark, [(1, same), (2, [0.25] * 64), (3, [-0.25] * 64)])
    check(spark, [(i, [float(x)] * 4) for i, x in enumerate([0, 1, 2, 3, 4, 2, 2])], dims=4, k=2)
    check(spark, [(i, [x, 1.0, -x]) for i, x in enumerate([1e7, -1e7, 3e7, 2.0, 0.0, 1e3])], dims=3, k=2)


def test_no_vectors(spark):
    got = vafile.clustered(frame(spark, [(1, None), (2, [1.0])]))
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("dims", [5, 64])
def test_intervals_hold_and_spare_vectors(dims):
    rng = np.random.default_rng(3)
    v = rng.integers(-40, 40, (500, dims)) + 200 * rng.integers(0, 3, (500, 1))
    edges = [[int(v[:, d].min()), *(int(x) for x in np.quantile(v[:, d], np.arange(1, 16) / 16)), int(v[:, d].max()) + 1] for d in range(dims)]
    packed = vafile.packed_cells(v, edges)
    assert packed.shape[1] == (dims + 1) // 2
    cells, centroids = vafile.unpacked_cells(packed, dims), [[int(x) for x in v[np.flatnonzero(v.mean(1) // 100 == g)[0]]] for g in (0, 1, 2, 3) if (v.mean(1) // 100 == g).any()]
    low, high = vafile.lookup_tables(centroids, edges)
    exact = vafile.distances(v, centroids)
    at = np.arange(dims)
    assert all((low[at, c].sum(0) <= e).all() and (high[at, c].sum(0) >= e).all() for c, e in zip(cells, exact, strict=True))
    near, fetched = vafile.nearest(cells, lambda rows: v[rows], centroids, low, high)
    assert (near == exact.argmin(1)).all() and fetched < 500

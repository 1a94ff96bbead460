"""Integer k-means with bounds against a brute-force version in Python integers."""

import hashlib
import math
import os
import random

import numpy as np
import pytest

from sectiva.llm import centroids
from sectiva.llm._common import shared_dir

SCHEMA = "vec_id bigint, embedding array<double>, label int, cluster int, v string"


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    """Rows (vec_id, embedding) as the operator's report rows, every distance computed every round."""
    kept = [(i, [math.floor(scale * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = [sum(d for _, d, j in found if j == a) for a in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, per[j], sum(per), sha[j]) for i, d, j in found), key=repr)


def report(spark, rows, **more):
    df = spark.createDataFrame([(i, e, 0, 7, "x") for i, e in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in centroids.cluster_report(centroids.hamerly_clusters(df, **more)).collect()), key=repr)


def blobs(n, seed, spread):
    rng = random.Random(seed)
    tops = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(tops)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.6])
def test_equals_brute_force(spark, spread):
    rows = blobs(160, 3, spread)
    assert report(spark, rows) == brute(rows)


def test_ties_copies_and_odd_vectors(spark):
    rng = random.Random(8)
    grid = [(i, [rng.choice((-1 / 64, 0.0, 1 / 64)) if j < 3 else 0.0 for j in range(64)]) for i in range(60)]
    hot = [(100 + i, grid[0][1]) for i in range(60)]
    far = [(300, [1e5] * 64), (301, [-1e5] * 64), (302, [-0.0] * 64)]
    odd = [(400, None), (401, []), (402, [0.0] * 63), (403, [0.0] * 65), (404, [None] + [0.0] * 63), (405, [math.nan] + [0.0] * 63), (406, [math.inf] * 64), (None, [0.5] * 64), (5, grid[7][1]), (5, grid[7][1])]
    rows = grid + hot + far + odd
    assert report(spark, rows) == brute(rows)


def test_few_and_no_vectors(spark):
    rows = blobs(5, 1, 0.1)
    assert report(spark, rows) == brute(rows)
    assert report(spark, [(1, None)]) == []
    assert report(spark, []) == []


def test_vectors_beyond_the_size_limit_are_left_out(spark):
    rows = blobs(20, 2, 0.1)
    assert report(spark, [*rows, (99, [1e30] * 64), (98, [centroids.LIMIT / 64.0] * 64)]) == brute(rows)


def test_floats_are_read_as_doubles(spark):
    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in blobs(60, 5, 0.3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted((tuple(r) for r in centroids.cluster_report(centroids.hamerly_clusters(df)).collect()), key=repr) == brute(rows)


def test_bounds_spare_scans_and_stay_valid(spark):
    """Over a third of the vectors, those of groups with one centroid, are scanned once in four assignments; bounds hold for every vector after every round."""
    df = spark.createDataFrame(blobs(400, 6, 0.02), "vec_id bigint, embedding array<double>")
    found = centroids.hamerly_clusters(df)
    scans = [r.n_scans for r in found.rows.select("n_scans").collect()]
    assert len(scans) == 400 and scans.count(1) > 400 / 3 and max(scans) <= 4
    rng = np.random.default_rng(1)
    v, old = rng.integers(-90, 90, (300, 64)), rng.integers(-90, 90, (7, 64))
    import pyarrow as pa

    first = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(list(v.astype(np.int32)), pa.list_(pa.int32()))], names=["vec_id", "v"])
    state = next(centroids._first([first], old))
    for _ in range(4):
        new = old + rng.integers(-9, 9, old.shape)
        state, old = next(centroids._next([state], new, old)), new
        d = np.sqrt(((v[:, None] - old[None]) ** 2).sum(axis=2))
        at = state.column("cluster").to_numpy()
        assert (at == ((v[:, None] - old[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
        assert (state.column("upper").to_numpy() >= d[np.arange(300), at]).all()
        d[np.arange(300), at] = np.inf
        assert (state.column("lower").to_numpy() <= d.min(axis=1)).all()


def test_earlier_states_are_deleted(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = {x for x in os.listdir(folder) if x.startswith(("vectors-", "clusters-"))}
    centroids.hamerly_clusters(spark.createDataFrame(blobs(30, 6, 0.1), "vec_id bigint, embedding array<double>"))
    assert len({x for x in os.listdir(folder) if x.startswith(("vectors-", "clusters-"))} - before) == 1

"""Integer k-means whose vectors keep Hamerly bounds from round to round.

Each vector carries its cluster, an upper bound on the distance to that cluster's centroid and a
lower bound on the distance to every other one.  When centroids have moved, the bounds are loosened by
the drift; a vector whose upper bound still lies under the lower bound, or under half the distance
from its centroid to the nearest other one, keeps its cluster unseen.  The upper bound of any other is
first made tight by its one exact distance, and only vectors that are ambiguous even then get a full
scan, in exact integers with ties to the smaller number.  Bounds are floating point, widened by a
margin above its rounding error, and a comparison must be strict, so they never decide a tie.

The state of a round (components, cluster, bounds) is written to the shared folder, and the one
before it deleted, so a lost executor repeats part of one round.  What reaches the driver is a
sum of components for each cluster.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectiva.llm._common import drop_stage, materialise, small_batches

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components from this size on are refused: squared distances must fit a long.
LIMIT = 1 << 27
#: Components under this size have distances that floating point holds exactly.
FLOAT_LIMIT = 1 << 22
MARGIN = 1e-12


@dataclass
class Clusters:
    """``rows``: (vec_id, v, cluster, distance, n_scans); ``centroids``: (k, dims) integers; ``sizes`` and ``inertias`` by cluster."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: list[int]
    inertias: list[int]


def quantised(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer components floor(scale * x) of the vectors that have ``dims`` finite components under the size limit."""
    big = LIMIT / scale
    x = F.col(embedding)
    kept = F.coalesce((F.size(x) == dims) & F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < big, F.lit(False)) & ~F.isnan(e.cast("double"))), F.lit(False))
    return df.filter(kept).select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: str = "1") -> np.ndarray:
    """The vectors of the ``k`` smallest digests of their ids; equal ids by components, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = rows.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in got], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(len(v), len(c)) exact squared distances of integer vectors."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < FLOAT_LIMIT:
        a, b = v.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)


def scan(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number), its squared distance, and a lower bound of the distance to any other."""
    d = squared(v, c)
    near = d.argmin(axis=1)
    best = d[np.arange(len(v)), near]
    if len(c) == 1:
        return near, best, np.full(len(v), np.inf)
    return near, best, np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(float)) * (1 - MARGIN)


def upper(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(float)) * (1 + MARGIN)


def _columns(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _first(batches, c: np.ndarray):
    for b in batches:
        near, best, lo = scan(_columns(b, c.shape[1]), c)
        yield _state(b, near, upper(best), lo, best, np.ones(len(near), np.int64))


def _next(batches, c: np.ndarray, old: np.ndarray):
    """One round: bounds loosened by drift, tightened where they don't decide, scanned where that doesn't either."""
    drift = upper(((c - old) ** 2).sum(axis=1))
    gaps = squared(c, c).astype(float)
    np.fill_diagonal(gaps, np.inf)
    half = np.sqrt(gaps.min(axis=1)) / 2 * (1 - MARGIN)
    order = np.argsort(-drift, kind="stable")
    most, second = drift[order[0]], drift[order[1]] if len(c) > 1 else 0.0
    for b in batches:
        v = _columns(b, c.shape[1])
        at = b.column("cluster").to_numpy().astype(np.int64)
        hi = (b.column("upper").to_numpy() + drift[at]) * (1 + MARGIN)
        lo = (b.column("lower").to_numpy() - np.where(at == order[0], second, most)) * (1 - MARGIN)
        lo = np.where(lo > 0, lo, 0.0)
        d2, scans = np.full(len(at), -1, np.int64), b.column("n_scans").to_numpy().copy()
        open_ = np.flatnonzero(hi >= np.maximum(lo, half[at]))
        d2[open_] = ((v[open_] - c[at[open_]]) ** 2).sum(axis=1)
        hi[open_] = upper(d2[open_])
        open_ = open_[hi[open_] >= np.maximum(lo, half[at])[open_]]
        if len(open_):
            at = at.copy()
            at[open_], d2[open_], lo[open_] = scan(v[open_], c)
            hi[open_] = upper(d2[open_])
            scans[open_] += 1
        yield _state(b, at, hi, lo, d2, scans)


def _last(batches, c: np.ndarray, old: np.ndarray):
    """As ``_next``, with the exact distance of every vector."""
    for b in _next(batches, c, old):
        v, at = _columns(b, c.shape[1]), b.column("cluster").to_numpy()
        d2 = ((v - c[at]) ** 2).sum(axis=1)
        yield b.set_column(b.schema.get_field_index("distance"), "distance", pa.array(d2, pa.int64()))


def _state(b: pa.RecordBatch, at, hi, lo, d2, scans) -> pa.RecordBatch:
    rest = [pa.array(at.astype(np.int32)), pa.array(hi), pa.array(lo), pa.array(d2, pa.int64()), pa.array(scans, pa.int64())]
    return pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), *rest], names=["vec_id", "v", "cluster", "upper", "lower", "distance", "n_scans"])


def _means(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """Floors of the componentwise means of each cluster; an empty cluster keeps its centroid."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i].cast("bigint")).alias(f"s{i}") for i in range(old.shape[1])))
    new = old.copy()
    for r in sums.collect():
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(old.shape[1])]
    return new


def hamerly_clusters(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "1") -> Clusters:
    """Clusters of the integer vectors floor(scale * x): ``rounds`` of assignment and means, then a last assignment.

    Vectors with another number of components, or a null or non-finite one, are left out, and so are those with a
    component of 2^27 / scale or more, whose squared distances need not fit a long.  Repeated rows and ids count
    each; a null id is kept and chosen as a first centroid after all others.  With fewer than ``k`` vectors there are
    as many centroids as vectors; equal centroids leave all but the first empty, which then stay.  An empty table
    gives no rows.  Other columns are ignored.
    """
    small_batches(df.sparkSession)
    rows = materialise(quantised(df, vec_id, embedding, dims, scale), "vectors")
    c = first_centroids(rows, k, seed)
    shape = f"vec_id {dict(rows.dtypes)['vec_id']}, v array<int>, cluster int, upper double, lower double, distance bigint, n_scans bigint"
    if not len(c):
        return Clusters(rows.mapInArrow(lambda it: iter(()), shape).select("vec_id", "v", "cluster", "distance", "n_scans"), c, [], [])
    state, old = rows, None
    for step in range(rounds + 1):
        if old is None:
            found = state.mapInArrow(lambda it, c=c: _first(it, c), shape)
        else:
            found = state.mapInArrow(lambda it, c=c, old=old, f=_next if step < rounds else _last: f(it, c, old), shape)
        before, state = state, materialise(found, "clusters")
        drop_stage(before)
        if step < rounds:
            old, c = c, _means(state, c)
    per = {r.cluster: (r.n, int(r.d)) for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    return Clusters(state.select("vec_id", "v", "cluster", "distance", "n_scans"), c, [per.get(i, (0, 0))[0] for i in range(len(c))], [per.get(i, (0, 0))[1] for i in range(len(c))])


def centroid_sha256(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()


def _of(values: list, kind: str) -> Column:
    """The value of a row's cluster."""
    return F.element_at(F.array(*(F.lit(x) for x in values)), F.col("cluster") + 1).cast(kind)


def cluster_report(found: Clusters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every clustered vector."""
    hashes = [centroid_sha256(x) for x in found.centroids] or [""]
    inertias = found.inertias or [0]
    return found.rows.select(
        "vec_id", "cluster", "distance", _of(inertias, "bigint").alias("cluster_inertia"), F.lit(sum(inertias)).cast("bigint").alias("inertia"), _of(hashes, "string").alias("centroid_sha256"),
    )


def _sql() -> str:
    """Exact rounds in SQL: every vector against every centroid."""
    parts = [
        f"""k AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {DIMS} AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NOT NULL AND isfinite(x) THEN 1 ELSE 0 END), 'sum') = {DIMS}),
v AS (SELECT vec_id, i, CAST(floor({SCALE} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM k, range(1, {DIMS + 1}) AS r(i)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM k QUALIFY c < {CLUSTERS}),
c0 AS (SELECT f.c, v.i, v.x FROM f JOIN v USING (vec_id))"""
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"d{n} AS (SELECT v.vec_id, c.c, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{n} c USING (i) GROUP BY ALL)")
        parts.append(f"a{n} AS (SELECT vec_id, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if n < ROUNDS:
            parts.append(f"m{n} AS (SELECT a.c, v.i, sum(v.x) AS s, count(*) AS n FROM a{n} a JOIN v USING (vec_id) GROUP BY ALL)")
            parts.append(f"c{n + 1} AS (SELECT c.c, c.i, CAST(coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS BIGINT) AS x FROM c{n} c LEFT JOIN m{n} m USING (c, i))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN h USING (c)"""


SQL = _sql()

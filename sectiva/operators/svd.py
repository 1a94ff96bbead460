"""Truncated singular value decomposition of long (row, term, weight) tables by subspace iteration.

A block of hash-drawn directions is multiplied by the matrix and its transpose, each time a join and sums by row or by term, and made orthonormal by
the small matrix of its inner products, which is all that the driver sees.  Rows stay sparse; only the block, a few dozen numbers a row or
term, is dense.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectiva.sources.stages import written

#: Directions beyond those asked for, and products with the matrix and its transpose.
OVERSAMPLE, ITERATIONS = 10, 8
#: Directions whose inner product falls below this share of the largest are dropped.
TINY = 1e-13


@dataclass
class Svd:
    """``values`` in falling order; ``terms`` (term, v): right singular vectors; ``rows`` (row, svd): rows on them, that is left vectors times values."""

    values: list[float]
    terms: DataFrame
    rows: DataFrame


def _normal(c: Column, j: int, seed: int) -> Column:
    """A standard normal number from the hash of a value."""
    unit = lambda k: (F.pmod(F.xxhash64(c, F.lit(k), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(2 * j))) * F.cos(2 * math.pi * unit(2 * j + 1))


def _times(long: DataFrame, side: DataFrame, on: str, to: str, width: int) -> DataFrame:
    """(to, x): sums of the weights times the other side's arrays."""
    joined = long.join(side.withColumnsRenamed({on: "on_", "x": "x_"}), F.col(on) == F.col("on_"))
    sums = joined.groupBy(to).agg(*(F.sum(F.col("weight") * F.col("x_")[j]).alias(f"s{j}") for j in range(width)))
    return written(sums.select(to, F.array(*(F.col(f"s{j}") for j in range(width))).alias("x")), "block")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return x.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _inner(batches):
    total = None
    for b in batches:
        if b.num_rows:
            x = _matrix(b)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])


def inner_products(block: DataFrame, width: int) -> np.ndarray:
    total = np.zeros((width, width))
    for r in block.mapInArrow(_inner, "g binary").collect():
        total += np.frombuffer(r.g, float).reshape(width, width)
    return total


def _turn(batches, m: np.ndarray):
    for b in batches:
        x = _matrix(b) @ m if b.num_rows else np.zeros((0, m.shape[1]))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), values], names=[b.schema.field(0).name, "x"])


def turned(block: DataFrame, m: np.ndarray) -> DataFrame:
    """A block's arrays times a small matrix."""
    return block.mapInArrow(lambda it: _turn(it, m), block.schema)


def _spread(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of an inner-product matrix in falling order, without the tiny ones, and their vectors."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    order = [i for i in np.argsort(-values) if values[i] > TINY * max(values.max(initial=0), 1e-300)]
    return values[order], vectors[:, order]


def truncated_svd(weights: DataFrame, row: str, term: str, k: int, value: str = "weight", oversample: int = OVERSAMPLE, iterations: int = ITERATIONS, seed: int = 0) -> Svd:
    """The ``k`` largest singular values (fewer if the rank is lower) of the uncentred matrix of a long table, and both sides.

    Repeated (row, term) pairs add up; zero weights and nulls are left out; a row without weights is in no result.  A component's sign makes the sum of the cubes
    of its term weights positive.
    """
    long = written(weights.filter(F.col(value).isNotNull() & (F.col(value) != 0) & F.col(row).isNotNull() & F.col(term).isNotNull()).groupBy(F.col(row).alias("row"), F.col(term).alias("term")).agg(F.sum(F.col(value).cast("double")).alias("weight")), "long")
    width = k + oversample
    z = written(long.select("term").distinct().select("term", F.array(*(_normal(F.col("term"), j, seed) for j in range(width))).alias("x")), "block")
    for i in range(iterations + 1):
        if i:
            z = _times(long, _times(long, z, "term", "row", width), "row", "term", width)
        for _ in range(2):
            values, vectors = _spread(inner_products(z, width))
            width = len(values)
            if not width:
                empty = long.select("row", F.array().cast("array<double>").alias("svd"))
                return Svd([], long.select("term", F.array().cast("array<double>").alias("v")).limit(0), empty.limit(0))
            z = written(turned(z, vectors / np.sqrt(values)), "block")
    y = _times(long, z, "term", "row", width)
    values, vectors = _spread(inner_products(y, width))
    values, vectors = values[:k], vectors[:, :k]
    v = written(turned(z, vectors), "block")
    cubes = v.agg(*(F.sum(F.pow(F.col("x")[j], F.lit(3.0))).alias(f"c{j}") for j in range(len(values)))).first()
    sign = np.diag([-1.0 if cubes[j] < 0 else 1.0 for j in range(len(values))])
    return Svd([float(x) for x in np.sqrt(values)], turned(v, sign).select(F.col("term").alias(term), F.col("x").alias("v")), turned(y, vectors @ sign).select(F.col("row").alias(row), F.col("x").alias("svd")))

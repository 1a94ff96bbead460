"""Many linear models at once over the same sparse rows: folds, strengths and feature choices in one pass each step.

Rows are packed into blocks of arrays, written once; a packed row stands for all rows that are equal in everything but their key.  A model is a training set (a bit of each row's mask), a
strength and a weight for each block of features.  What differs between training sets, inverse document frequencies, means and
deviations, scales columns; unit lengths are taken inside the pass.  So all models
share one copy of the data, and one job computes the losses, gradients and diagonal curvatures of all
of them.  A step is a limited-memory quasi-Newton step that starts from the curvature at the present point, each model with its own history and
line search; models that have settled leave the pass.  What reaches the driver is a gradient for each model, summed
in a tree of tasks where there are many.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectiva.sources.stages import written

#: Training sets that one mask can hold.
MOST_SETS = 62
#: Coefficients of all models of one solve that the driver and each worker hold at most; more models are solved in turns.
MOST_COEFFICIENTS = 40_000_000
#: Rows of a packed block and of a partition.
PACK_ROWS, PARTITION_ROWS = 2048, 50_000
#: Numbers of a gradient that travel as one row, and partial gradients that the driver adds up itself.
CHUNK, FLAT = 1 << 16, 64
MEMORY = 30
LOG, SQUARED_HINGE = "log", "squared_hinge"


@dataclass(frozen=True)
class Fit:
    """One model: its training set, inverse strength of the penalty, weights by block (absent: 1, 0: off) and loss.

    The penalty is half the squared length of the coefficients, against ``c`` times the sum of losses with balanced classes; ``free`` leaves the intercept out of it.
    """

    group: int
    c: float = 1.0
    weights: tuple[tuple[str, float], ...] = ()
    loss: str = LOG
    free: bool = True


@dataclass
class Problem:
    """Packed rows and what training sets know about features.

    ``blocks``: names of the feature blocks in order of their columns, the dense numbers last; ``starts``: their first columns; ``unit``: whether a row's part
    of a block is scaled to unit length; ``keys``: (key, same), the packed row of each row; ``scales``: (columns, sets) factors, 0 where a set lacks the column; ``numbers``: medians, means and deviations, (sets, numbers) each.
    """

    packed: DataFrame
    blocks: list[str]
    starts: list[int]
    unit: list[bool]
    scales: np.ndarray
    numbers: tuple[np.ndarray, np.ndarray, np.ndarray]
    classes: np.ndarray
    parts: int
    keys: DataFrame

    @property
    def columns(self) -> int:
        return len(self.scales)

    @property
    def dense(self) -> int:
        return self.numbers[0].shape[1]


# ---- packing ----


def _pack(batches):
    names = ["keys", "y", "train", "test", "weight", "ends", "idx", "tf", "num"]
    for batch in batches:
        for lo in range(0, batch.num_rows, PACK_ROWS):
            b = batch.slice(lo, PACK_ROWS)
            idx, num = b.column("idx"), b.column("num")
            parts = [
                b.column("y").to_numpy(zero_copy_only=False).astype(np.int8), b.column("train").to_numpy(), b.column("test").to_numpy(), b.column("weight").to_numpy().astype(float), np.cumsum(pa.compute.list_value_length(idx).to_numpy()).astype(np.int64),
                idx.flatten().to_numpy().astype(np.int32), b.column("tf").flatten().to_numpy().astype(float), num.flatten().to_numpy(zero_copy_only=False).astype(float),
            ]
            keys = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("same"))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=names)


def pack(rows: DataFrame, n_rows: int) -> tuple[DataFrame, int]:
    """(packed, partitions) of rows (same, y, train, test, weight, idx, tf, num): masks of training and test sets, how many rows it stands for, ascending columns with values, dense numbers with nulls."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // PARTITION_ROWS))
    arrays = ", ".join(f"{c} binary" for c in ("y", "train", "test", "weight", "ends", "idx", "tf", "num"))
    dealt = rows.select("same", "y", "train", "test", "weight", "idx", "tf", "num").repartition(parts)
    return written(dealt.mapInArrow(_pack, f"keys array<string>, {arrays}"), "packed").persist(StorageLevel.MEMORY_AND_DISK), parts


class Block:
    """The arrays of a packed row, and the (row, feature block) segments of its cells."""

    def __init__(self, batch: pa.RecordBatch, at: int, starts: list[int], dense: int):
        get = lambda name, kind: np.frombuffer(batch.column(name)[at].as_buffer(), kind)
        self.y, self.train, self.test = get("y", np.int8), get("train", np.int64), get("test", np.int64)
        self.weight = get("weight", float)
        self.n, self.idx, self.tf = len(self.y), get("idx", np.int32), get("tf", float)
        self.num = get("num", float).reshape(self.n, dense)
        ends = get("ends", np.int64)
        self.row = np.repeat(np.arange(self.n), np.diff(ends, prepend=0))
        block = np.searchsorted(np.array(starts[1:] or [0]), self.idx, "right") if len(starts) > 1 else np.zeros(len(self.idx), np.int64)
        tag = self.row * len(starts) + block if starts else self.row
        self.first = np.flatnonzero(np.diff(tag, prepend=-1))
        self.segment_row, self.segment_block = self.row[self.first], block[self.first]
        self.segment_size = np.diff(self.first, append=len(tag))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of cell values by row."""
        if not len(values):
            return np.zeros(self.n)
        return np.bincount(self.segment_row, np.add.reduceat(values, self.first), self.n)

    def cells(self, scale: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Cell values under a training set's column factors, unit lengths taken."""
        v = self.tf * scale[self.idx]
        if not len(v):
            return v
        length = np.sqrt(np.add.reduceat(v * v, self.first))
        factor = np.where(unit[self.segment_block] & (length > 0), 1 / np.where(length > 0, length, 1), 1.0)
        return v * np.repeat(factor, self.segment_size)

    def dense(self, median: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(self.num), median, self.num) - mean) / sd


def _blocks(batches, starts, dense):
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.column("keys")[at].values, Block(batch, at, starts, dense)


# ---- passes ----


def _loss(loss: str, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Losses, their slopes and their curvatures at margins ``z`` for labels 0 and 1."""
    if loss == LOG:
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return np.logaddexp(0, z) - y * z, p - y, p * (1 - p)
    sign = 2.0 * y - 1
    short = np.maximum(0, 1 - sign * z)
    return short * short, -2 * sign * short, 2.0 * (short > 0)


def _margins(b: Block, v: np.ndarray, x: np.ndarray, m: dict, w: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Margins of a block's rows, and its cells under a model's block weights."""
    u = v * np.repeat(m["by_block"][:-1][b.segment_block], b.segment_size)
    return b.sums(u * w[b.idx]) + x @ (w[columns:-1] * m["by_block"][-1]) + w[-1], u


def _gradients(batches, told):
    """One row for each chunk of the task's sums: gradient, curvature and loss of each model, one model after another."""
    p, models, w = cloudpickle.loads(told.value)
    columns, width = p["columns"], p["columns"] + p["dense"] + 1
    total = np.zeros((len(models), 2 * width + 1))
    seen = False
    for _, b in _blocks(batches, p["starts"], p["dense"]):
        seen = True
        for g in sorted({m["group"] for m in models}):
            own = (b.train >> g & 1).astype(bool)
            if not own.any():
                continue
            v, x = b.cells(p["scales"][g], p["unit"]), b.dense(*(a[g] for a in p["numbers"]))
            weight = np.where(b.y == 1, p["balance"][g][1], p["balance"][g][0]) * own * b.weight
            for k, m in enumerate(models):
                if m["group"] != g:
                    continue
                z, u = _margins(b, v, x, m, w[k], columns)
                loss, slope, curve = _loss(m["loss"], z, b.y)
                for at, r, cells, dense in ((0, slope * weight, u, x * m["by_block"][-1]), (width, curve * weight, u * u, (x * m["by_block"][-1]) ** 2)):
                    if len(u):
                        total[k, at : at + columns] += np.bincount(b.idx, cells * r[b.row], columns)
                    total[k, at + columns : at + width - 1] += r @ dense
                    total[k, at + width - 1] += r.sum()
                total[k, -1] += (loss * weight).sum()
    if seen:
        flat = total.ravel()
        yield _chunks({i: flat[i * CHUNK : (i + 1) * CHUNK] for i in range(-(-len(flat) // CHUNK))})


def _chunks(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["chunk", "sums"])


def _add(batches):
    parts: dict[int, np.ndarray] = {}
    for b in batches:
        for k, sums in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(sums.as_buffer(), float)
            parts[k] = parts[k] + x if k in parts else x
    yield _chunks(parts)


def _moments(batches, told):
    """Count, mean and summed squares of each number, for each training set, medians filled in; merged pairwise."""
    p = cloudpickle.loads(told.value)
    sets, dense = len(p["medians"]), p["dense"]
    n, mean, m2 = np.zeros((sets, 1)), np.zeros((sets, dense)), np.zeros((sets, dense))
    for _, b in _blocks(batches, [], dense):
        for g in range(sets):
            own = (b.train >> g & 1).astype(bool)
            x, w = np.where(np.isnan(b.num), p["medians"][g], b.num)[own], b.weight[own]
            if len(x):
                middle = w @ x / w.sum()
                n[g], mean[g], m2[g] = merged((n[g], mean[g], m2[g]), (w.sum(), middle, w @ (x - middle) ** 2))
    yield pa.RecordBatch.from_arrays([pa.array([np.hstack([n, mean, m2]).tobytes()], pa.binary())], names=["x"])


def merged(a, b):
    """Count, mean and summed squares of two samples together."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


def number_moments(packed: DataFrame, medians: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of the numbers of each training set; a deviation of 0 counts as 1."""
    sets, dense = medians.shape
    told = packed.sparkSession.sparkContext.broadcast(cloudpickle.dumps({"medians": medians, "dense": dense}))
    total = None
    for r in packed.mapInArrow(lambda it: _moments(it, told), "x binary").collect():
        x = np.frombuffer(r.x, float).reshape(sets, 1 + 2 * dense)
        if total is None:
            total = x
            continue
        n = np.maximum(total[:, :1] + x[:, :1], 1)
        d = x[:, 1 : 1 + dense] - total[:, 1 : 1 + dense]
        mean = total[:, 1 : 1 + dense] + d * x[:, :1] / n
        total = np.hstack([total[:, :1] + x[:, :1], mean, total[:, 1 + dense :] + x[:, 1 + dense :] + d * d * total[:, :1] * x[:, :1] / n])
    if total is None:
        return np.zeros_like(medians), np.ones_like(medians)
    sd = np.sqrt(total[:, 1 + dense :] / np.maximum(total[:, :1], 1))
    return total[:, 1 : 1 + dense].copy(), np.where(sd > 0, sd, 1.0)


class Sums:
    """Runs passes over a problem's rows."""

    def __init__(self, problem: Problem):
        self.problem, self.sc = problem, problem.packed.sparkSession.sparkContext
        n = problem.classes.sum(axis=1, keepdims=True)
        balance = np.where(problem.classes > 0, n / (2.0 * np.maximum(problem.classes, 1)), 0.0)
        self.shared = {"starts": problem.starts, "unit": np.array([*problem.unit, False]), "dense": problem.dense, "columns": problem.columns, "scales": np.ascontiguousarray(problem.scales.T), "numbers": problem.numbers, "balance": balance}

    def model(self, fit: Fit) -> dict:
        own = dict(fit.weights)
        return {"group": fit.group, "loss": fit.loss, "by_block": np.array([own.get(b, 1.0) for b in self.problem.blocks])}

    def __call__(self, models: list[dict], w: np.ndarray) -> np.ndarray:
        """(models, 2 * width + 1): gradients, curvatures and the loss of each; the width is that of the coefficients, the intercept last."""
        told = self.sc.broadcast(cloudpickle.dumps((self.shared, models, w)))
        rows = self.problem.packed.mapInArrow(lambda it: _gradients(it, told), "chunk bigint, sums binary")
        width = 2 * (self.problem.columns + self.problem.dense + 1) + 1
        size = len(models) * width
        if self.problem.parts > FLAT:
            group = F.pmod(F.spark_partition_id(), F.lit(int(self.problem.parts**0.5)))
            rows = rows.withColumn("group", group).repartition("group", "chunk").drop("group").mapInArrow(_add, "chunk bigint, sums binary")
        total = np.zeros(-(-size // CHUNK) * CHUNK)
        for r in rows.collect():
            x = np.frombuffer(r.sums, float)
            total[r.chunk * CHUNK : r.chunk * CHUNK + len(x)] += x
        told.destroy()
        return total[:size].reshape(len(models), width)


# ---- optimiser ----


class Descent:
    """Limited-memory quasi-Newton descent of one model, fed one loss, gradient and diagonal curvature at a time."""

    def __init__(self, start: np.ndarray, tol: float):
        self.w, self.tol = start, tol
        self.trial, self.step, self.done, self.f = start, 1.0, False, None
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.tries = self.steps = 0

    def take(self, f: float, g: np.ndarray, curvature: np.ndarray) -> None:
        """The loss, gradient and curvature at ``trial``; sets the next trial, or ``done``."""
        if self.f is not None:
            slope = self.g @ self.direction
            if f > self.f + 1e-4 * self.step * slope + 1e-12 * abs(self.f):
                self.tries += 1
                if self.tries > 30:
                    self.done = True
                    return
                self.step *= min(0.5, max(0.1, -slope * self.step / (2 * (f - self.f - slope * self.step))))
                self.trial = self.w + self.step * self.direction
                return
            s, y = self.trial - self.w, g - self.g
            if (sy := s @ y) > 1e-14 * (y @ y):
                self.pairs = [*self.pairs[-(MEMORY - 1) :], (s, y, 1 / sy)]
        self.w, self.f, self.g, self.tries, self.steps = self.trial, f, g, 0, self.steps + 1
        self.inverse = 1 / np.maximum(curvature, 1e-12)
        if np.abs(self.inverse * g).max(initial=0) <= self.tol * max(1.0, np.abs(self.w).max(initial=0)):
            self.done = True
            return
        self.direction, self.step = -self.solve(g), 1.0
        if g @ self.direction >= 0:
            self.pairs, self.direction = [], -self.inverse * g
        self.trial = self.w + self.direction

    def solve(self, g: np.ndarray) -> np.ndarray:
        q, used = g.copy(), []
        for s, y, rho in reversed(self.pairs):
            a = rho * (s @ q)
            used.append(a)
            q -= a * y
        scale = 1.0
        if self.pairs:
            s, y, rho = self.pairs[-1]
            scale = 1 / (rho * (y @ (self.inverse * y)))
        q *= self.inverse * scale
        for (s, y, rho), a in zip(self.pairs, reversed(used), strict=True):
            q += (a - rho * (y @ q)) * s
        return q


def solve(problem: Problem, fits: list[Fit], tol: float = 1e-5, max_steps: int = 300, warm: np.ndarray | None = None) -> np.ndarray:
    """(fits, columns + numbers + 1) coefficients of every model, the intercept last.

    Coefficients are those of the scaled columns.  Fits of one training set and choice of features that differ in strength start from the
    solution of the weakest of them; ``warm`` starts all of them elsewhere.
    """
    width = problem.columns + problem.dense + 1
    room = max(1, MOST_COEFFICIENTS // width)
    if len(fits) > room:
        return np.vstack([solve(problem, fits[i : i + room], tol, max_steps, None if warm is None else warm[i : i + room]) for i in range(0, len(fits), room)])
    sums = Sums(problem)
    family = lambda f: replace(f, c=0.0)
    weakest = {family(f): min(x.c for x in fits if family(x) == family(f)) for f in fits}
    start = np.zeros((len(fits), width)) if warm is None else warm
    if warm is None and any(f.c != weakest[family(f)] for f in fits):
        first = [f for f in dict.fromkeys(fits) if f.c == weakest[family(f)]]
        found = dict(zip(map(family, first), _descend(sums, first, np.zeros((len(first), width)), max(tol, 1e-3), max_steps), strict=True))
        start = np.array([found[family(f)] for f in fits])
    return _descend(sums, fits, start, tol, max_steps)


def _descend(sums: Sums, fits: list[Fit], start: np.ndarray, tol: float, max_steps: int) -> np.ndarray:
    models, runs, width = [sums.model(f) for f in fits], [Descent(w, tol) for w in start], start.shape[1]
    penalties = [np.append(np.ones(width - 1), 0.0 if f.free else 1.0) for f in fits]
    for _ in range(max_steps):
        live = [k for k, d in enumerate(runs) if not d.done]
        if not live:
            break
        got = sums([models[k] for k in live], np.array([runs[k].trial for k in live]))
        for k, row in zip(live, got, strict=True):
            d, penalty, c = runs[k], penalties[k], fits[k].c
            d.take(0.5 * float(penalty @ (d.trial * d.trial)) + c * float(row[-1]), penalty * d.trial + c * row[:width], penalty + c * row[width:-1])
    return np.array([d.w for d in runs]).reshape(len(fits), -1)


# ---- scores ----


def _scores(batches, told):
    p, models, w = cloudpickle.loads(told.value)
    for keys, b in _blocks(batches, p["starts"], p["dense"]):
        for g in sorted({m["group"] for m in models}):
            own = np.flatnonzero(b.test >> g & 1)
            if not len(own):
                continue
            v, x = b.cells(p["scales"][g], p["unit"]), b.dense(*(a[g] for a in p["numbers"]))
            for k, m in enumerate(models):
                if m["group"] == g:
                    z, _ = _margins(b, v, x, m, w[k], p["columns"])
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), pa.array(b.y[own].astype(np.int32)), pa.array(np.full(len(own), k, np.int32)), pa.array(z[own])], names=["same", "y", "fit", "margin"])


def held_out(problem: Problem, fits: list[Fit], w: np.ndarray) -> DataFrame:
    """(key, y, fit, margin, proba): margins of the rows in each fit's test set; ``fit`` is the place in ``fits``."""
    sums = Sums(problem)
    told = sums.sc.broadcast(cloudpickle.dumps((sums.shared, [sums.model(f) for f in fits], w)))
    # Written, so that Spark knows whether the scores of unlike rows are few enough to be sent to all tasks.
    scores = written(problem.packed.mapInArrow(lambda it: _scores(it, told), "same string, y int, fit int, margin double"), "margins")
    return problem.keys.join(scores, "same").select("key", "y", "fit", "margin", (1 / (1 + F.exp(-F.col("margin")))).alias("proba"))

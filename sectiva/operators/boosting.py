"""Gradient boosting with oblivious trees, ordered by a permutation: a row's residual never comes from a model that has seen the row.

Rows are put in a hash order and in stretches that double in length.  A model is kept for each stretch, fitted on all rows up to its end; all models
share the trees' splits, and each has its own leaf values.  Splits are chosen from residuals of each row by the model of the stretch before its own.  Categories become
smoothed mean labels of the rows before a row in the same order.  Numbers fall into slots at exact quantiles.  One job for each
level adds up slopes and curvatures by leaf, feature and slot; that table, whatever the rows, is what the driver sees.  Every so many trees the rows'
scores are written with them, so that a pass walks few trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectiva.operators.ordered import ranged, running
from sectiva.operators.quantiles import quantiles
from sectiva.sources.stages import written

SLOTS, STRETCHES, PACK_ROWS, REFRESH = 32, 8, 4096, 20
PRIOR, SMOOTHING = 0.5, 1.0


@dataclass
class Trees:
    """Slot edges of features, and trees as (splits, leaf values): splits are (feature, slot) of each level, values one row a stretch."""

    numbers: list[str]
    categories: list[str]
    edges: list[list[float]]
    levels: dict[str, DataFrame]
    trees: list[tuple[list[tuple[int, int]], np.ndarray]] = field(default_factory=list)


def permuted(key: str, seed: int) -> Column:
    """A number in [0, 1) by which rows are ordered."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def ordered_statistics(df: DataFrame, category: str, label: str, order: str, out: str, prior: float = PRIOR, smoothing: float = SMOOTHING) -> DataFrame:
    """``df`` with the smoothed mean label of the rows before each row with its category, in a global order; a hot category is spread over ranges.

    Rows that share ``order`` are taken in any order; null is a category.
    """
    total = running(ranged(df, category, order), [order], {"_s": F.col(label).cast("double"), "_c": F.lit(1)}, [category])
    return total.withColumn(out, (F.col("_s") - F.col(label) + smoothing * prior) / (F.col("_c") - 1 + smoothing)).drop("_s", "_c", "_range")


def _slots(names: list[str], edges: list[list[float]]) -> Column:
    """Slots of a row's features: 0 for null, then one for each edge that the value is over."""

    def slot(name: str, own: list[float]) -> Column:
        over = F.size(F.filter(F.array(*map(F.lit, own)), lambda edge: F.col(name) > edge)) if own else F.lit(0)
        return F.when(F.col(name).isNull(), F.lit(0)).otherwise(1 + over).cast("int")

    return F.array(*(slot(n, e) for n, e in zip(names, edges, strict=True)))


def _pack(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, PACK_ROWS):
            b = batch.slice(lo, PACK_ROWS)
            parts = [b.column("slots").flatten().to_numpy().astype(np.uint8), b.column("y").to_numpy(zero_copy_only=False).astype(np.int8), b.column("place").to_numpy().astype(float), b.column("weight").to_numpy().astype(float)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (*parts, np.zeros((STRETCHES, b.num_rows)))], names=["slots", "y", "place", "weight", "scores"])


PACKED = "slots binary, y binary, place binary, weight binary, scores binary"


def stretch(place: np.ndarray) -> np.ndarray:
    """Stretch of each row: 0 holds the first 2^-(n - 1) of the order, each next one doubles what there is."""
    return np.clip(STRETCHES + np.floor(np.log2(np.maximum(place, 1e-300))), 0, STRETCHES - 1).astype(int)


def leaf_of(slots: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    at = np.zeros(len(slots), int)
    for f, s in splits:
        at = 2 * at + (slots[:, f] > s)
    return at


def _rows(batches, trees):
    """(slots, y, stretch, weight, scores by all models, raw row) of packed rows, trees since the written scores added."""
    for b in batches:
        for i in range(b.num_rows):
            y = np.frombuffer(b.column("y")[i].as_buffer(), np.int8)
            slots = np.frombuffer(b.column("slots")[i].as_buffer(), np.uint8).reshape(len(y), -1)
            scores = np.frombuffer(b.column("scores")[i].as_buffer(), float).reshape(STRETCHES, len(y)).copy()
            for splits, values in trees:
                scores += values[:, leaf_of(slots, splits)]
            yield slots, y, stretch(np.frombuffer(b.column("place")[i].as_buffer(), float)), np.frombuffer(b.column("weight")[i].as_buffer(), float), scores, b.slice(i, 1)


def _unseen(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Scores of rows by the model of the stretch before their own; the first stretch has none, so 0."""
    return np.where(own > 0, scores[np.maximum(own - 1, 0), np.arange(len(own))], 0.0)


def _histograms(batches, told, splits):
    features, trees = cloudpickle.loads(told.value)
    total = np.zeros((1 << len(splits), features, SLOTS + 1, 2))
    for slots, y, own, weight, scores, _ in _rows(batches, trees):
        p = 1 / (1 + np.exp(-_unseen(scores, own)))
        leaf = leaf_of(slots, splits)
        for f in range(features):
            at = leaf * (SLOTS + 1) + slots[:, f]
            for k, x in enumerate(((y - p) * weight, p * (1 - p) * weight)):
                total[:, f, :, k] += np.bincount(at, x, (1 << len(splits)) * (SLOTS + 1)).reshape(-1, SLOTS + 1)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])


def _leaves(batches, told, splits):
    _, trees = cloudpickle.loads(told.value)
    total = np.zeros((STRETCHES, 1 << len(splits), 2))
    for slots, y, own, weight, scores, _ in _rows(batches, trees):
        leaf = leaf_of(slots, splits)
        for j in range(STRETCHES):
            p, seen = 1 / (1 + np.exp(-scores[j])), (own <= j) * weight
            for k, x in enumerate(((y - p) * seen, p * (1 - p) * seen)):
                total[j, :, k] += np.bincount(leaf, x, 1 << len(splits))
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])


def _scored(batches, told):
    for *_, scores, raw in _rows(batches, cloudpickle.loads(told.value)[1]):
        yield raw.set_column(4, "scores", pa.array([scores.tobytes()], pa.binary()))


def _sum(packed: DataFrame, told, f, splits, shape) -> np.ndarray:
    total = np.zeros(shape)
    for r in packed.mapInArrow(lambda it: f(it, told, splits), "x binary").collect():
        total += np.frombuffer(r.x, float).reshape(shape)
    return total


def best_split(h: np.ndarray, penalty: float) -> tuple[int, int]:
    """(feature, slot) whose cut, the same in every leaf, gains most; ties go to the first."""
    left = np.cumsum(h, axis=2)
    right = left[:, :, -1:] - left
    gain = sum((x[..., 0] ** 2 / (x[..., 1] + penalty)).sum(axis=0) for x in (left, right))
    f, s = np.unravel_index(np.argmax(np.round(gain[:, :-1], 12)), gain[:, :-1].shape)
    return int(f), int(s)


def ordered_boosting(df: DataFrame, key: str, label: str, numbers: list[str], categories: list[str], rounds: int = 50, depth: int = 4, rate: float = 0.1, penalty: float = 3.0, seed: int = 0) -> Trees:
    """Trees fitted on ``df`` with balanced classes; the same rows and seed give the same trees, however rows are dealt.

    ``key`` orders the rows by hash and should be unique; null numbers have a slot of their own, null is a category.
    """
    names = [*(f"num_{i}" for i in range(len(numbers))), *(f"stat_{i}" for i in range(len(categories)))]
    rows = written(df.select(F.col(label).cast("int").alias("y"), permuted(key, seed).alias("place"), *(F.col(n).cast("double").alias(f"num_{i}") for i, n in enumerate(numbers)), *(F.col(c).cast("string").alias(f"cat_{i}") for i, c in enumerate(categories))), "boosted")
    levels = {c: written(rows.groupBy(F.col(f"cat_{i}").alias("level")).agg(((F.sum("y") + SMOOTHING * PRIOR) / (F.count("*") + SMOOTHING)).alias("stat")), "levels") for i, c in enumerate(categories)}
    for i in range(len(categories)):
        rows = written(ordered_statistics(rows, f"cat_{i}", "y", "place", f"stat_{i}"), "boosted")
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(n).alias("x")) for i, n in enumerate(names)))).alias("v")
    found = {r.i: sorted({r[f"q{j}"] for j in range(SLOTS - 1)}) for r in quantiles(rows.select(values).select("v.i", "v.x"), "x", [(j + 1) / SLOTS for j in range(SLOTS - 1)], ["i"]).collect()}
    model = Trees(numbers, categories, [found.get(i, []) for i in range(len(names))], levels)
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return model
    n = sum(sizes.values())
    weight = F.when(F.col("y") == 1, n / (2.0 * sizes[1])).otherwise(n / (2.0 * sizes[0]))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // 50_000))
    packed = written(rows.select(_slots(names, model.edges).alias("slots"), "y", "place", weight.alias("weight")).repartition(parts).mapInArrow(_pack, PACKED), "packed").persist(StorageLevel.MEMORY_AND_DISK)
    recent: list = []
    for t in range(rounds):
        if t and t % REFRESH == 0:
            told = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps((len(names), recent)))
            fresh = written(packed.mapInArrow(lambda it, told=told: _scored(it, told), PACKED), "packed").persist(StorageLevel.MEMORY_AND_DISK)
            packed.unpersist()
            packed, recent = fresh, []
        told, splits = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps((len(names), recent))), []
        for d in range(depth):
            splits.append(best_split(_sum(packed, told, _histograms, list(splits), (1 << d, len(names), SLOTS + 1, 2)), penalty))
        sums = _sum(packed, told, _leaves, splits, (STRETCHES, 1 << depth, 2))
        recent.append((splits, np.round(rate * sums[..., 0] / (sums[..., 1] + penalty), 12)))
        model.trees.append(recent[-1])
        told.destroy()
    packed.unpersist()
    return model


def _score(batches, trees):
    for b in batches:
        slots = b.column("slots").flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0), int)
        total = np.zeros(b.num_rows)
        for splits, values in trees:
            total += values[-1][leaf_of(slots, splits)]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(1 / (1 + np.exp(-total)))], names=["key", "proba"])


def boosted_scores(model: Trees, df: DataFrame, key: str) -> DataFrame:
    """(key, proba) of rows by the model of all training rows; categories have the mean labels of the training rows, unknown ones the prior."""
    rows = df.select(F.col(key).alias("key"), *(F.col(n).cast("double").alias(f"num_{i}") for i, n in enumerate(model.numbers)), *(F.col(c).cast("string").alias(f"cat_{i}") for i, c in enumerate(model.categories)))
    for i, c in enumerate(model.categories):
        rows = rows.join(model.levels[c], F.col(f"cat_{i}").eqNullSafe(F.col("level")), "left").withColumn(f"stat_{i}", F.coalesce("stat", F.lit(PRIOR))).drop("level", "stat")
    names = [*(f"num_{i}" for i in range(len(model.numbers))), *(f"stat_{i}" for i in range(len(model.categories)))]
    trees = model.trees
    slotted = rows.select("key", _slots(names, model.edges).alias("slots"))
    return slotted.mapInArrow(lambda it: _score(it, trees), f"key {dict(slotted.dtypes)['key']}, proba double")

"""Feature tables of many training sets at once: terms are counted, numbered and written once, whatever the sets.

Rows carry two masks, one bit for each training set: ``train`` where the row belongs to it, ``test`` where its score is wanted.  Document
frequencies, levels, medians and class sizes of all sets come from the same aggregates.  Titles and records repeat across rows: a text
is counted and numbered once with the number of rows that have it, and rows that are equal in everything but their key are packed once with a weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectiva.operators.ordered import ranged, running
from sectiva.operators.quantiles import quantiles
from sectiva.operators.solver import MOST_COEFFICIENTS, MOST_SETS, Problem, number_moments, pack
from sectiva.sources.stages import written


@dataclass(frozen=True)
class Terms:
    """TF-IDF of an array column: a block of features."""

    block: str
    column: str
    min_df: int = 2
    max_features: int | None = None
    sublinear: bool = False


def bit(mask: Column, g: int) -> Column:
    return F.getbit(mask, F.lit(g)).cast("bigint")


def _code(bag: Column) -> Column:
    """128 bits that tell arrays of terms apart; null and empty are one, and null terms, which no column stands for, count as none."""
    return F.concat_ws(",", *(F.xxhash64(F.lit(seed), bag).cast("string") for seed in (0, 1)))


def fold_masks(fold: str, k: int) -> dict[str, Column]:
    """Masks of k-fold validation: a row trains the sets of the other folds and is tested by its own."""
    own = F.expr(f"shiftleft(1L, cast({fold} as int))")
    return {"train": F.lit((1 << k) - 1).cast("bigint").bitwiseXOR(own), "test": own}


def design(rows: DataFrame, key: str, label: str, sets: int, texts: list[Terms], categories: list[str], numbers: list[str], number_block: str = "numbers", weight: str | None = None) -> Problem:
    """A problem for ``solver`` from rows with ``train`` and ``test`` masks; ``key`` must be unique, ``label`` 0 or 1; a row stands for ``weight`` equal ones.

    Text blocks have smooth inverse document frequencies over the rows of a training set and unit length; a category's levels are those of the
    set, null is none; numbers are scaled by the set's mean and population deviation, nulls filled with its median, 0 where it has none.
    What the driver and each worker hold, a factor for each column and set, is limited; more is an error.
    """
    if not 0 < sets <= MOST_SETS:
        raise ValueError(f"between 1 and {MOST_SETS} training sets")
    names = [t.block for t in texts] + list(categories)
    bags = [F.col(t.column) for t in texts] + [F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string"))) for c in categories]
    base = rows.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"), "train", "test", (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("times"), *(c.alias(f"bag_{i}") for i, c in enumerate(bags)), *(F.col(c).cast("double").alias(f"number_{i}") for i, c in enumerate(numbers)))
    sizes = base.agg(*(F.sum(bit(F.col("train"), g) * F.col("times") * F.col("y")).alias(f"p{g}") for g in range(sets)), *(F.sum(bit(F.col("train"), g) * F.col("times")).alias(f"n{g}") for g in range(sets)), F.count("*").alias("n"), *(F.count_if(F.col(f"number_{i}").isNull()).alias(f"null_{i}") for i in range(len(numbers)))).first()
    n = [sizes[f"n{g}"] or 0 for g in range(sets)]
    classes = np.array([[n[g] - (sizes[f"p{g}"] or 0), sizes[f"p{g}"] or 0] for g in range(sets)], float)
    dense = F.array(*(F.col(f"number_{i}") for i in range(len(numbers)))) if numbers else F.array().cast("array<double>")
    coded = base.select("key", "y", "train", "test", "times", *(_code(F.col(f"bag_{i}")).alias(f"code_{i}") for i in range(len(names))), dense.alias("num"))
    codes = [f"code_{i}" for i in range(len(names))]
    said = F.concat_ws("|", *codes, *(F.col(c).cast("string") for c in ("y", "train", "test")), F.transform("num", lambda v: F.coalesce(v.cast("string"), F.lit("none"))))
    coded = written(coded.withColumn("same", F.md5(said)), "coded")
    unlike = written(coded.groupBy("same", "y", "train", "test", *codes, "num").agg(F.sum("times").alias("weight")), "unlike")
    vectors = []
    if names:
        # A text or level that many rows share is taken apart once.
        each = (base.groupBy(F.lit(i).alias("block"), _code(F.col(f"bag_{i}")).alias("code"), F.col(f"bag_{i}").alias("bag")).agg(*(F.sum(bit(F.col("train"), g) * F.col("times")).alias(f"n{g}") for g in range(sets))) for i in range(len(names)))
        terms = reduce(lambda a, b: a.unionByName(b), each).select("block", "code", F.array(*(f"n{g}" for g in range(sets))).alias("ns"), F.explode("bag").alias("term"))
        cells = written(terms.groupBy("block", "code", "ns", "term").agg(F.count("*").alias("tf")), "cells")
        vocabulary = written(_vocabulary(cells, texts, len(names), sets, n), "vocabulary")
        if vocabulary.count() * sets > MOST_COEFFICIENTS:
            raise ValueError(f"over {MOST_COEFFICIENTS} factors of columns and training sets: raise min_df, or set max_features")
        known = vocabulary.select("block", "index", "idf").collect()
        counts = np.bincount([r.block for r in known], minlength=len(names)) if known else np.zeros(len(names), int)
        scales = np.zeros((len(known), sets))
        for r in known:
            scales[r["index"]] = [x or 0.0 for x in r.idf]
        sub = F.element_at(F.array(*(F.lit(i < len(texts) and texts[i].sublinear) for i in range(len(names)))), F.col("block") + 1)
        value = F.when(F.col("block") >= len(texts), F.lit(1.0)).when(sub, 1 + F.log("tf")).otherwise(F.col("tf").cast("double"))
        found = cells.join(vocabulary.select(F.col("block").alias("block_"), F.col("term").alias("term_"), "index"), (F.col("block") == F.col("block_")) & (F.col("term") == F.col("term_"))).select("block", "code", F.struct(F.col("index").cast("int").alias("i"), value.alias("v")).alias("x"))
        vectors = written(found.groupBy("block", "code").agg(F.array_sort(F.collect_list("x")).alias("cells")), "vectors")
        # Apart by block, so that Spark knows the size of each and sends small ones to all tasks.
        vectors = [written(vectors.filter(F.col("block") == i).select(F.col("code").alias(f"code_{i}"), F.col("cells").alias(f"cells_{i}")), f"vectors{i}") for i in range(len(names))]
    else:
        counts, scales = np.zeros(0, int), np.zeros((0, sets))
    joined = reduce(lambda a, b: a.join(b, b.columns[0], "left"), vectors, unlike)
    none = F.array().cast("array<struct<i:int,v:double>>")
    # Columns are numbered by block, so those of one block after another ascend.
    x = F.concat(*(F.coalesce(f"cells_{i}", none) for i in range(len(names)))) if names else none
    packed, count = pack(joined.select("same", "y", "train", "test", "weight", x.alias("x"), "num").select("*", F.transform("x", lambda e: e["i"]).alias("idx"), F.transform("x", lambda e: e["v"]).alias("tf")), unlike.count())
    medians = _medians(base, len(numbers), [i for i in range(len(numbers)) if sizes[f"null_{i}"]], sets)
    mean, sd = number_moments(packed, medians) if numbers else (medians, medians)
    return Problem(packed, [*names, number_block], [int(s) for s in np.cumsum(counts) - counts], [i < len(texts) for i in range(len(names))], scales, (medians, mean, sd), classes, count, coded.select("key", "same"))


def _vocabulary(cells: DataFrame, texts: list[Terms], blocks: int, sets: int, n: list[int]) -> DataFrame:
    """(block, term, index, idf): terms that any training set knows, numbered by block and name, with an array of their factors by set."""
    at = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("block") + 1)
    least = at([t.min_df for t in texts] + [1] * (blocks - len(texts)))
    df = lambda g: F.col(f"df{g}")
    ranked = {i: t.max_features for i, t in enumerate(texts) if t.max_features}
    rows = lambda g: F.get("ns", F.lit(g))
    totals = [F.sum(rows(g) * F.col("tf")).alias(f"total{g}") for g in range(sets)] if ranked else []
    stats = cells.groupBy("block", "term").agg(*(F.sum(rows(g)).alias(f"df{g}") for g in range(sets)), *totals)
    stats = written(stats.filter(reduce(lambda a, b: a | b, (df(g) >= least for g in range(sets)))), "terms")
    allowed = F.lit(True)
    if ranked:
        each = stats.filter(F.col("block").isin(*ranked)).select("block", "term", F.explode(F.array(*(F.when(df(g) >= least, F.struct(F.lit(g).alias("g"), F.col(f"total{g}").alias("total"))) for g in range(sets)))).alias("x")).filter("x is not null").select("block", "term", "x.g", "x.total")
        over = [r for r in each.groupBy("block", "g").agg(F.count("*").alias("n")).collect() if r.n > ranked[r.block]]
        if over:
            each = each.filter(reduce(lambda a, b: a | b, ((F.col("block") == r.block) & (F.col("g") == r.g) for r in over)))
            most = F.element_at(F.create_map(*(F.lit(v) for kv in ranked.items() for v in kv)), F.col("block"))
            order = [F.desc("total"), "term"]
            dealt = running(ranged(each, "block", "g", *order), order, {"rank": F.lit(1)}, ["block", "g"]).filter(F.col("rank") > most)
            gone = dealt.groupBy(F.col("block").alias("block_"), F.col("term").alias("term_")).agg(F.bit_or(F.expr("shiftleft(1L, g)")).alias("gone"))
            stats = stats.join(gone, (F.col("block") == F.col("block_")) & (F.col("term") == F.col("term_")), "left").drop("block_", "term_")
            allowed = F.coalesce("gone", F.lit(0).cast("bigint"))
    keeps = (lambda g: bit(allowed, g) == 0) if ranked and "gone" in stats.columns else (lambda g: F.lit(True))
    idf = [F.when((df(g) >= least) & keeps(g), F.when(F.col("block") < len(texts), F.log((1 + n[g]) / (1.0 + df(g))) + 1).otherwise(1.0)) for g in range(sets)]
    known = stats.select("block", "term", F.array(*idf).alias("idf")).filter(F.exists("idf", lambda v: v.isNotNull()))
    return running(ranged(known, "block", "term"), ["block", "term"], {"index": F.lit(1)}).select("block", "term", (F.col("index") - 1).alias("index"), "idf")


def _medians(base: DataFrame, numbers: int, gaps: list[int], sets: int) -> np.ndarray:
    """(sets, numbers) medians over each training set of the numbers that have nulls; others need none."""
    out = np.zeros((sets, numbers))
    if gaps:
        values = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"number_{i}").alias("x")) for i in gaps))).alias("v")
        own = F.explode(F.filter(F.sequence(F.lit(0), F.lit(sets - 1)), lambda g: F.getbit("train", g) == 1)).alias("g")
        for r in quantiles(base.select("train", "times", values).select("v.i", "v.x", "times", own), "x", [0.5], ["g", "i"], weight="times").collect():
            out[r.g, r.i] = r.q0
    return out

"""Exact quantiles by counting: each pass counts values by a coarser digit, then only the digit that holds the rank is looked into.

The first pass counts values by sign and power of two, the next ones by 2^16 equal slots between the least and the
greatest value of the slot that holds a rank.  A power of two holds 2^52 values, so four such passes
always suffice; fewer do where values are few.  Several quantiles of many groups share the passes, a group's rows meet in no task, and
what moves are counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectiva.sources.stages import written

SLOTS = 1 << 16
#: Passes after the first: a power of two's 2^52 values in steps of 2^16, and one for rounding.
PASSES = 5


def _times(weight: str | None) -> Column:
    return (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("times")


def _first_slot(x: Column) -> Column:
    """Sign and power of two, in the order of values: minus infinity, negative, zero, positive, infinity, not a number."""
    power = F.floor(F.log2(F.abs(x))).cast("int") + 1200
    finite = F.when(x == 0, 0).when(x > 0, power).otherwise(-power)
    return F.when(F.isnan(x), 9000).when(x == float("inf"), 8000).when(x == float("-inf"), -8000).otherwise(finite)


def _found(counts: DataFrame, ranks: DataFrame, by: list[str], also: list[str]) -> DataFrame:
    """(by, rank, left, low, high): for each rank the slot that holds it; ``left`` is the rank inside it.

    counts: (by, also, slot, n, low, high); ranks: (by, also, rank, left).
    """
    own = [*by, *also]
    upto = F.sum("n").over(Window.partitionBy(*(own or [F.lit(0)])).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}__")) for c in own), (F.col("left") >= F.col("before")) & (F.col("left") < F.col("upto")))
    named = spans.withColumnsRenamed({c: f"{c}__" for c in own}).withColumnsRenamed({"low": "low_", "high": "high_"})
    return ranks.join(named, on).select(*by, "rank", (F.col("left") - F.col("before")).alias("left"), F.col("low_").alias("low"), F.col("high_").alias("high"))


def order_statistics(values: DataFrame, column: str, ranks: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(by, rank, value): the values of given ranks (from 0) of each group; ``ranks`` is (by, rank), nulls in ``column`` are left out; a row counts ``weight`` times."""
    rows = values.select(*by, F.col(column).cast("double").alias("x"), _times(weight)).filter("x is not null")
    counted = lambda df, slot, own: df.groupBy(*own, slot.alias("slot")).agg(F.sum("times").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    at = written(_found(counted(rows, _first_slot(F.col("x")), by), ranks.select(*by, "rank", F.col("rank").alias("left")), by, []), "ranks")
    same = lambda a, b: a.eqNullSafe(b)
    for _ in range(PASSES):
        open_ = at.filter("low < high")
        if open_.isEmpty():
            break
        cells = open_.select(*(F.col(c).alias(f"{c}__") for c in by), "low", "high").distinct()
        inside = (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))
        looked = rows.join(cells, reduce(lambda a, b: a & b, (same(F.col(c), F.col(f"{c}__")) for c in by), inside)).drop(*(f"{c}__" for c in by))
        slot = F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * SLOTS).cast("int")
        counts = looked.groupBy(*by, F.col("low").alias("from"), F.col("high").alias("to"), slot.alias("slot")).agg(F.sum("times").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        asked = open_.select(*by, "rank", "left", F.col("low").alias("from"), F.col("high").alias("to"))
        at = written(_found(counts, asked, by, ["from", "to"]).unionByName(at.filter("not (low < high)")), "ranks")
    return at.select(*by, "rank", F.col("low").alias("value"))


def quantiles(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None, prefix: str = "q", weight: str | None = None) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles with linear interpolation, as many as ``shares``, per group.

    Nulls are left out; a group without values has no row, a frame without values and without ``by`` one row of nulls.  Not a number counts as the greatest value.
    A row counts ``weight`` times, a whole number of at least 1.
    """
    names = [f"by{i}" for i in range(len(by or []))]
    values = df.select(*(F.col(c).alias(n) for n, c in zip(names, by or [], strict=True)), F.col(column).cast("double").alias("x"), _times(weight))
    sizes = values.filter("x is not null").groupBy(*names).agg(F.sum("times").alias("n")).filter("n > 0")
    spots = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("spot")) for i, p in enumerate(shares)))
    asked = written(sizes.select(*names, F.explode(spots).alias("s")).select(*names, "s.i", F.floor("s.spot").alias("lo"), F.ceil("s.spot").alias("hi"), "s.spot"), "spots")
    ranks = asked.select(*names, F.col("lo").alias("rank")).unionByName(asked.select(*names, F.col("hi").alias("rank"))).distinct()
    got = order_statistics(values, "x", ranks, names, "times")

    def value(side: str) -> DataFrame:
        return got.select(*(F.col(c).alias(f"{c}__{side}") for c in names), F.col("rank").alias(f"rank_{side}"), F.col("value").alias(f"value_{side}"))

    for side in ("lo", "hi"):
        on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}__{side}")) for c in names), F.col(side) == F.col(f"rank_{side}"))
        asked = asked.join(value(side), on).drop(*(f"{c}__{side}" for c in names))
    gap = F.col("spot") - F.col("lo")
    between = F.when((F.col("lo") == F.col("hi")) | (F.col("value_lo") == F.col("value_hi")), F.col("value_lo")).otherwise(F.col("value_lo") + (F.col("value_hi") - F.col("value_lo")) * gap)
    found = asked.withColumn("v", between).groupBy(*names).agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"q{i}") for i in range(len(shares))))
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, by or [], strict=True)), *(F.col(f"q{i}").alias(f"{prefix}{i}") for i in range(len(shares))))

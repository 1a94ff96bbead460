"""Running totals, ranks and exact quantiles over a global order, without a task that sees all rows.

Rows are dealt to ranges of their key and written with the number of their range.  Totals of the ranges give
each range's offset; inside a range, totals run locally.  Only the list of ranges is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectiva.sources.stages import written

Order = list[Column | str]


def ranged(df: DataFrame, *order: Column | str, out: str = "_range", parts: int | None = None) -> DataFrame:
    """``df`` dealt to ranges of ``order``, written with the number of each row's range; equal keys share a range."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id()), "ranges")


def _null_safe(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    on = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in names]
    return a.join(b.withColumnsRenamed({c: f"{c}__" for c in names}), reduce(lambda x, y: x & y, on)).drop(*(f"{c}__" for c in names))


def running(rows: DataFrame, order: Order, totals: dict[str, Column], by: list[str] | None = None, combine: Callable = F.sum, plus: Callable = lambda a, b: a + b, part: str = "_range") -> DataFrame:
    """``rows`` of ``ranged`` with running totals, up to and including each row, of the columns ``totals``, per group of ``by``.

    The order must be the one that the ranges were made by, after ``by``; rows that are equal in it are taken in any order.  ``combine``
    is an aggregate and ``plus`` adds two of its results.  Nulls in totals count as nothing.
    """
    by = by or []
    local = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, part).agg(*(combine(c).alias(f"{n}_off") for n, c in totals.items()))
    offsets = sums.select(*by, part, *(combine(f"{n}_off").over(before).alias(f"{n}_off") for n in totals))
    got = _null_safe(rows.withColumns({n: combine(c).over(local) for n, c in totals.items()}), offsets, [*by, part])
    zero = lambda n: F.coalesce(n, F.lit(0))
    return got.withColumns({n: plus(zero(n), zero(f"{n}_off")) for n in totals}).drop(*(f"{n}_off" for n in totals))


def dense_ranks(values: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): distinct values numbered from 0 in their order."""
    rows = ranged(values, column)
    return running(rows, [column], {out: F.lit(1)}).select(column, (F.col(out) - 1).alias(out))

"""Bounded labelled samples for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: F.Column, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, y): at most ``limit`` labelled rows of each class from the rows where ``fold`` holds.

    The choice is by hash of the id, the same in every run.  The chosen ids are few by construction,
    so they are broadcast; texts are read whole.  Repeated rows count once; an id
    that different texts share is left out, since its label may be of either.
    """
    rows = labels.select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("y")).filter(F.col("k").isNotNull() & F.col("y").isNotNull() & fold)
    rows = rows.groupBy("k").agg(F.max("y").alias("y"))
    order = (F.xxhash64(F.col("k").cast("string"), F.lit(17)), F.col("k"))
    chosen = [rows.filter(F.col("y") == y).orderBy(*order).limit(limit) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return found.join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).groupBy("doc_id", "y").agg(F.min("text").alias("text"), F.max("text").alias("other")).filter(F.col("text").eqNullSafe(F.col("other"))).select("doc_id", "text", "y")

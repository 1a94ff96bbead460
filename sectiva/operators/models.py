"""A logistic model with balanced classes on Spark's own optimiser, its scores, target statistics and cached tables; ``solver``, ``boosting`` and ``svd`` have the others."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Row weights that make both classes weigh alike: n / (2 * class size)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    w = sizes.crossJoin(total).select(F.col(label).alias("_y"), (F.col("_n") / (F.col("_k") * F.col("_c"))).alias(out))
    return df.join(F.broadcast(w), F.col(label) == F.col("_y")).drop("_y")


#: Rows of one partition while a model is fitted: each step is a pass over all partitions.
FIT_ROWS = 50_000


def logistic(df: DataFrame, label: str = "label", features: str = "features", c: float = 1.0, max_iter: int = 200, tol: float = 1e-7):
    """L2 logistic regression whose penalty is 1 / C against the summed weighted loss.

    Balanced weights add up to the number of rows, so that number is the penalty's scale.
    """
    kept = df.select(F.col(label).cast("double").alias("_label"), features).persist()
    n = kept.count()
    rows = balanced_weights(kept, "_label", "_weight").coalesce(1 + n // FIT_ROWS).persist()
    try:
        model = LogisticRegression(featuresCol=features, labelCol="_label", weightCol="_weight", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
        return model.fit(rows)
    finally:
        rows.unpersist()
        kept.unpersist()


def score(model, df: DataFrame, out: str = "proba") -> DataFrame:
    """``df`` with the probability of class 1, or the raw margin of a model without probabilities."""
    got = model.transform(df)
    column = "probability" if "probability" in got.columns else "rawPrediction"
    return got.withColumn(out, vector_to_array(column)[1]).drop("rawPrediction", "probability", "prediction")


def ordered_target_statistics(df: DataFrame, key: str, label: str, order: str, prior: float = 0.5, out: str = "target_stat") -> DataFrame:
    """Smoothed mean label of the rows before each row with the same key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, (F.coalesce(F.sum(label).over(w), F.lit(0)) + prior) / (F.count(label).over(w) + 1))


def spec_hash(spec: dict, data_hash: str = "") -> str:
    """Cache key of a specification and its data."""
    return hashlib.sha256((json.dumps(spec, sort_keys=True, ensure_ascii=False) + data_hash).encode()).hexdigest()


def cached(spark, path: str, spec: dict, data_hash: str, make) -> DataFrame:
    """A table kept under the hash of what made it: read if it is there, else made and written."""
    where = f"{path.rstrip('/')}/{spec_hash(spec, data_hash)}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        make().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)

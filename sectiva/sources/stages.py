"""Stages written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only in local mode, where all tasks share a disk, an unset folder falls back on a local one.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", "file:///tmp/checkpoints" if sc.master.startswith("local[") or sc.master == "local" else None)
        if not shared:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def written(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Cut lineage: ``df`` written as Parquet under ``spark.checkpoint.dir`` and read back, as ``schema`` if one is given."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)

"""Helpers shared by the operators: inputs, materialised stages, Arrow row packing."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch to a Python worker holds at most; long texts make rows large.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small unless the session already asks for something smaller."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a local one in local mode, else an error."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", "file:///tmp/checkpoints" if sc.master == "local" or sc.master.startswith("local[") else None)
        if not shared:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a stage as Parquet in the shared folder and read it back.

    A lost executor costs no recomputation of what was written, and the files carry the sizes
    from which Spark decides on broadcasts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a stage that ``materialise`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    shared = hadoop(shared_dir(spark)).toUri().getPath()
    for where in {hadoop(f).getParent().toUri().toString() for f in df.inputFiles()}:
        path = hadoop(where)
        if path.toUri().getPath().startswith(f"{shared}/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession, value):
    """A broadcast of ``value`` pickled with its classes, so that executors need not have this package; ``shipped`` reads it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(sent):
    """The value of a broadcast made by ``ship``; call it once a task."""
    return cloudpickle.loads(sent.value)


def discard(spark: SparkSession) -> None:
    """Delete this session's materialised stages; call it once results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_kept(docs: DataFrame, text: str, keep) -> DataFrame:
    """Rows of ``docs``, with all their columns, that ``keep`` holds for; nothing is shuffled or joined.

    ``keep()`` is called once a task and gives a function from a list of texts to a list of booleans.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        judge = keep()
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def row_key(doc_id: str, text: str) -> Column:
    """Tells apart rows that share a doc_id but not a text."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a row."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)).cast("int")

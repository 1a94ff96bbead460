"""Every operator and the pipeline where executors can't import this package: a driver outside its folder that finds it by sys.path alone."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import corpus_pipeline
from sectiva.llm import queries
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "2g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def missing(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("sectiva") is None])], names=["gone"])

assert spark.range(1).mapInArrow(missing, "gone boolean").first().gone, "executors see the package"
found = dict(queries.queries(), pipeline=corpus_pipeline.run)
for name in {names!r}:
    print(name, found[name](spark, {data!r}).count(), flush=True)
"""


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Small tables in the form of the driver's."""
    import random

    from tests.llm.data import SCHEMA, documents

    folder, rng = tmp_path_factory.mktemp("tables"), random.Random(3)
    docs = [r for r in documents() if r[0] is not None]
    spark.createDataFrame(docs, SCHEMA).dropDuplicates(["doc_id"]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], r[0] % 2, r[0] % 3 % 2) for r in docs], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(docs[5][1].split()[:20]))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, k, r, f"{r} {i // 2}") for i in range(6) for k, r in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(64)], 0) for i in range(40)], "vec_id bigint, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_operators_run_where_executors_lack_the_package(data, tmp_path):
    from sectiva.llm import queries

    names = [*queries.queries(), "pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, names=names, data=data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    done = [line.split() for line in got.stdout.splitlines()]
    assert [x[0] for x in done] == names, got.stderr[-3000:]

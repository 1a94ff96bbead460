"""Readers with integrity checks, caches of responses, and result sinks."""

from __future__ import annotations

import csv
import io
import uuid
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 32765
RESPONSE = (
    "id bigint, prompt_version string, model string, temperature double, raw_response string, "
    "parsed struct<prediction:int,confidence:double,reasoning:string>, error string, timestamp string, "
    "sample_index int, retries_used int, latency_seconds double, prompt_tokens bigint, completion_tokens bigint"
)
FOLDS = "array<struct<train_idx:array<int>,val_idx:array<int>>>"


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def byte_profile(files: DataFrame) -> DataFrame:
    """(path, n_bytes, question_share, high_share, valid_utf8) of binary files."""
    hexes, n = F.hex("content"), F.octet_length("content")
    of = lambda pattern: F.regexp_count(F.regexp_replace(hexes, "(..)", "$1 "), F.lit(pattern)) / F.greatest(n, F.lit(1))
    return files.select("path", n.alias("n_bytes"), of("3F ").alias("question_share"), of("[89A-F]. ").alias("high_share"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid_utf8"))


def is_corrupted(files: DataFrame, limit: float = 0.5) -> DataFrame:
    """Files most of whose bytes are question marks."""
    return byte_profile(files).select("path", (F.col("question_share") > limit).alias("corrupted"))


def fingerprint(files: DataFrame) -> DataFrame:
    """(path, sha256, high_bytes): digest and the distinct bytes above ASCII, sorted."""
    pairs = F.regexp_extract_all(F.hex("content"), F.lit("(..)"), F.lit(1))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.array_sort(F.array_distinct(F.filter(pairs, lambda x: x >= "80"))).alias("high_bytes"))


def verify_digest(files: DataFrame, expected: str) -> None:
    """Raise unless every file has the pinned digest."""
    if files.filter(F.sha2("content", 256) != expected).limit(1).count():
        raise ValueError("a file differs from its pinned SHA-256")


def unchanged(before: DataFrame, after: DataFrame) -> bool:
    """Whether the same files have the same digests."""
    a, b = (fingerprint(x).select("path", "sha256") for x in (before, after))
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


#: Encodings that a table is tried in, in this order.
ENCODINGS = ("utf-8", "cp1251")


def decoded(content: bytes, path: str, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The text of a file in the first encoding that all its bytes fit, without a byte order mark; raises if none does."""
    for name in encodings:
        try:
            return content.decode(name).removeprefix("\ufeff")
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{path}: its bytes are neither of {', '.join(encodings)}")


def _parsed(batches, width: int, header: bool):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = decoded(content.as_buffer().to_pybytes(), path).replace("\r\n", "\n")
            lines = csv.reader(io.StringIO(text, newline=""), quoting=csv.QUOTE_NOTNULL)
            if header:
                next(lines, None)
            while rows := [r for r in islice(lines, 1000)]:
                cells = [(r + [None] * width)[:width] for r in rows if r]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in cells], pa.string()) for i in range(width)], names=[f"c{i}" for i in range(width)])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV files with quoted line breaks, each in UTF-8 if its bytes are, else in Windows-1251; a file that neither fits is an error.

    A folder may mix both.  A line end inside a value is read as one character, as Spark's own reader does.  Columns are those of ``schema`` in order; what is missing, empty and not quoted, or not of its column's type is null.
    Spark opens the files, a task for each, and a file must fit in a task's memory.
    """
    kind = spark.createDataFrame([], schema).schema
    texts = binary(spark, path).select("path", "content").mapInArrow(lambda it, n=len(kind): _parsed(it, n, header), ", ".join(f"c{i} string" for i in range(len(kind))))
    return texts.select(*(F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(kind)))


def assert_table(df: DataFrame, key: str, required: list[str], label: str | None = None, rows: int | None = None) -> DataFrame:
    """``df``, or an error for nulls, labels other than 0 and 1, or a wrong number of rows."""
    from sectiva.operators.aggregates import integrity

    got = integrity(df, key, required, label).first()
    if got["n_nulls"] or (rows is not None and got["n_rows"] != rows) or (label and got["labels_binary"] is False):
        raise ValueError(f"table check failed: {got.asDict()}")
    return df


def truncated(df: DataFrame, column: str, limit: int = LIMIT) -> DataFrame:
    """How many texts end exactly at a cell limit."""
    return df.agg(F.count_if(F.length(column) >= limit).alias("n_truncated"), F.count("*").alias("n"))


def question_guard(df: DataFrame, columns: list[str], limit: float = 0.05) -> DataFrame:
    """One row: share of question marks in text columns, and whether it is below the limit."""
    marks = sum((F.sum(F.length(c) - F.length(F.replace(F.col(c), F.lit("?"), F.lit("")))) for c in columns[1:]), F.sum(F.length(columns[0]) - F.length(F.replace(F.col(columns[0]), F.lit("?"), F.lit("")))))
    size = sum((F.sum(F.length(c)) for c in columns[1:]), F.sum(F.length(columns[0])))
    return df.agg(F.try_divide(marks, size).alias("share")).withColumn("ok", F.coalesce(F.col("share") < limit, F.lit(True)))


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(fold, row): validation rows of a fold file."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", FOLDS)).alias("fold", "f"))
    return raw.select("fold", F.explode("f.val_idx").alias("row"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one JSON record a file."""
    return spark.read.schema(RESPONSE).option("multiLine", True).json(path)


def parse_response(raw: Column) -> Column:
    return F.from_json(raw, "prediction int, confidence double, reasoning string")


def validate_cache(expected: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    """(key, problem): missing, unexpected, duplicate and malformed records: the retry queue."""
    tag = lambda df, name: df.select(key, F.lit(name).alias("problem"))
    return (
        tag(expected.select(key).distinct().join(cache, key, "left_anti"), "missing")
        .unionByName(tag(cache.select(key).distinct().join(expected, key, "left_anti"), "unexpected"))
        .unionByName(tag(cache.groupBy(key).count().filter("count > 1"), "duplicate"))
        .unionByName(tag(cache.filter(F.coalesce(parse_response(F.col("raw_response"))["prediction"].isNull(), F.lit(True))), "malformed"))
    )


def stale(expected: DataFrame, cache: DataFrame, key: str, *versions: str) -> DataFrame:
    """Keys to compute again: not cached, or cached under another version."""
    return expected.join(cache.select(key, *versions), [key, *versions], "left_anti").select(key)


def attach(df: DataFrame, feature: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with external columns; raises if a key is missing or a value is null."""
    from sectiva.operators.relational import strict_lookup

    got = strict_lookup(df, feature.select(key, *columns), key)
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    if got.filter(bad).limit(1).count():
        raise ValueError("an external value is null")
    return got


#: Rows of a group that ``label_digest`` takes at most.
MOST_LABELS = 1_000_000


def label_digest(df: DataFrame, position: str, label: str, by: list[str] | None = None, most: int = MOST_LABELS) -> DataFrame:
    """SHA-256 of labels in order of position, per group; a group of over ``most`` rows is an error, since one task would hold it."""
    sizes = df.groupBy(*(by or [])).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    if not sizes.isEmpty():
        raise ValueError(f"a group has over {most} labels")
    packed = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(label).cast("string").alias("l"))))
    return df.groupBy(*(by or [])).agg(F.sha2(F.array_join(F.transform(packed, lambda x: x["l"]), ""), 256).alias("sha256"))


def _renamed(spark: SparkSession, folder: str, path: str) -> None:
    """Move the only part file of a finished write to ``path`` and drop its folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [x.getPath() for x in fs.listStatus(hadoop(folder)) if x.getPath().getName().startswith("part-")]
    fs.delete(hadoop(path), True)
    if not fs.rename(part, hadoop(path)):
        raise OSError(f"{path} can't be written")
    fs.delete(hadoop(folder), True)


def write_file(df: DataFrame, path: str, order: list[str], columns: list[str]) -> str:
    """One ordered CSV file of exactly this name with CRLF line ends; gives its SHA-256.

    It is written beside its place first and moved there when it is whole, so a run that fails leaves what was there.
    """
    spark, folder = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    try:
        write_submission(df, folder, order, columns)
        _renamed(spark, folder, path)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return binary(spark, path).select(F.sha2("content", 256).alias("d")).first().d


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Rows added to a log under the name of their batch; the same batch again replaces its own rows, so a repeated run adds nothing."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def write_submission(df: DataFrame, path: str, order: list[str], columns: list[str]) -> None:
    """One ordered CSV with CRLF line ends; quotes inside a value are doubled, as ``read_table`` takes them."""
    df.orderBy(*order).select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Rows as nested JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def markdown(df: DataFrame, digits: int = 3, limit: int = 1000) -> str:
    """A small aggregate as a Markdown table."""
    show = lambda x: f"{x:.{digits}f}" if isinstance(x, float) else "" if x is None else str(x)
    rows = [[show(x) for x in r] for r in df.limit(limit).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])

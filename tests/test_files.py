"""Tables in mixed encodings, files that appear whole or not at all, batches that repeat, digests of bounded groups."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sectiva.sources import files

SCHEMA = "id bigint, title string, label int"


def test_a_folder_of_mixed_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,title,label\r\n1,"Болезнь\r\n# Лечение ""A""",1\r\n2,,\r\n'.encode())
    (tmp_path / "b.csv").write_bytes("id,title,label\n3,Возраст,0\n4,\"\",x\n5,short\n".encode("cp1251"))
    (tmp_path / "c.csv").write_bytes("﻿id,title,label\n6,é,7\n".encode())
    (tmp_path / "d.csv").write_bytes(b"")
    conf = spark.conf.get("spark.sql.legacy.javaCharsets")
    got = {r.id: (r.title, r.label) for r in files.read_table(spark, str(tmp_path), SCHEMA).collect()}
    assert got == {1: ('Болезнь\n# Лечение "A"', 1), 2: (None, None), 3: ("Возраст", 0), 4: ("", None), 5: ("short", None), 6: ("é", 7)}
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == conf


def test_bytes_that_fit_no_encoding_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id,title,label\n1,\x98\xff,1\n")
    with pytest.raises(Exception, match="neither"):
        files.read_table(spark, str(tmp_path), SCHEMA).collect()


def test_a_file_appears_whole_under_its_name(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\nc", 0), (1, 'a "q"', 1)], SCHEMA)
    path = tmp_path / "out.csv"
    digest = files.write_file(df, str(path), ["id"], ["id", "title", "label"])
    assert path.read_bytes() == b'id,title,label\r\n1,"a ""q""",1\r\n2,"b\r\nc",0\r\n' and digest == hashlib.sha256(path.read_bytes()).hexdigest()
    assert files.write_file(df, str(path), ["id"], ["id", "title", "label"]) == digest
    failing = df.withColumn("label", F.when(F.col("id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("label")))
    with pytest.raises(Exception, match="stop"):
        files.write_file(failing, str(path), ["id"], ["id", "title", "label"])
    assert hashlib.sha256(path.read_bytes()).hexdigest() == digest
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["out.csv"]
    back = {r.id: (r.title, r.label) for r in files.read_table(spark, str(path), SCHEMA).collect()}
    assert back == {1: ('a "q"', 1), 2: ("b\nc", 0)}


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 0)], SCHEMA)
    for batch in ("one", "two", "one"):
        files.append_batch(df, str(tmp_path / "log"), batch)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_digests_of_large_groups_are_refused(spark):
    df = spark.createDataFrame([(i, "a", i % 2) for i in range(5)], "p int, g string, l int")
    assert files.label_digest(df, "p", "l", ["g"]).first().sha256 == hashlib.sha256(b"01010").hexdigest()
    with pytest.raises(ValueError, match="over 4"):
        files.label_digest(df, "p", "l", ["g"], 4)

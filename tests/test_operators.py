"""Metrics, folds, decoding, models and sources against brute force."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sectiva.operators import aggregates, decode, metrics, models, relational, validation, vectorize
from sectiva.sources import files


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)], "y int, p double")
    assert metrics.auc(df, "y", "p").first().auc == pytest.approx(2 / 3)
    assert metrics.auc(df.filter("y = 1"), "y", "p").first().auc is None


def test_scorecard(spark):
    row = spark.createDataFrame([(372, 42, 81, 195)], "tp int, fp int, fn int, tn int").select(metrics.macro_f_beta(2.0).alias("f"), metrics.m2().alias("m")).first()
    assert row.f == pytest.approx(0.816074, abs=1e-6) and row.m == pytest.approx(0.702387, abs=1e-6)
    assert spark.createDataFrame([(5, 5, 0, 0)], "tp int, fp int, fn int, tn int").select(metrics.m2().alias("m")).first().m == 0


def test_sweep_matches_grid(spark):
    rng = np.random.default_rng(0)
    rows = [(int(y), float(p)) for y, p in zip(rng.integers(0, 2, 200), rng.integers(0, 100, 200) / 100, strict=True)]
    got = {round(r.threshold, 2): r for r in metrics.sweep(spark.createDataFrame(rows, "y int, p double"), "y", "p").collect()}
    assert len(got) == 91
    for t in (0.05, 0.3, 0.5, 0.95):
        assert got[t].tp == sum(y == 1 and p >= t for y, p in rows) and got[t].fp == sum(y == 0 and p >= t for y, p in rows)


def test_folds(spark):
    df = spark.range(103).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    sizes = [r["count"] for r in validation.stratified_folds(df, "id", "label").filter("label = 1").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 35
    grouped = validation.group_folds(df.withColumn("g", F.col("id") % 11), "g", 3)
    assert grouped.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_student_tail():
    assert validation.t_upper_tail(0.0, 5) == pytest.approx(0.5)
    assert validation.t_upper_tail(2.015, 5) == pytest.approx(0.05, abs=1e-4)
    assert validation.t_upper_tail(-2.015, 5) == pytest.approx(0.95, abs=1e-4)
    assert validation.passes_gate(0.01, 0.05, 4) and not validation.passes_gate(0.01, 0.2, 5)


def test_constant_feature_gains_nothing(spark):
    df = spark.createDataFrame([(f, 10, 0.7) for f in range(5)], "fold int, n int, macro_f2 double")
    got = validation.corrected_test(validation.paired_deltas(df, df, ["fold"]), 50)
    assert got["mean"] == 0 and not validation.passes_gate(got["mean"], got["p"], 0)


def test_decoding(spark):
    rows = [(1, "Лечение"), (2, "Леченье"), (3, "Диета"), (4, "Диета"), (5, "Травма головы"), (6, "Травма колена")]
    index = decode.line_index(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    asked = spark.createDataFrame([(9, "???????"), (9, "?????"), (1, "?????? ??????"), (5, "?????? ??????"), (9, "??")], "id int, m string")
    got = {(r.id, r.masked): (r.text, r.ambiguous, r.n_candidates) for r in decode.decode_lines(asked, index, "id", "m").collect()}
    assert got[9, "?????"] == ("Диета", False, 1)
    assert got[9, "???????"] == ("", True, 2)
    assert got[1, "?????? ??????"] == ("травма", True, 2)
    assert got[5, "?????? ??????"] == ("Травма колена", False, 1)
    assert got[9, "??"] == ("", False, 0)


def test_scaler_and_tfidf(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0), (4, 9.0), (5, None)], "id int, x double")
    s = vectorize.Scaler.fit(df, ["x"])
    assert s.stats["x"][0] == 3.0
    docs = spark.createDataFrame([(1, ["aa", "bb", "aa"]), (2, ["aa"]), (3, ["cc"])], "id int, t array<string>")
    w = {(r.id, r.term): r.weight for r in vectorize.TfIdf.fit(docs, "id", "t", 1).weights(docs, "id", "t").collect()}
    a, b = 2 * (math.log(4 / 3) + 1), math.log(4 / 2) + 1
    assert w[1, "aa"] == pytest.approx(a / math.hypot(a, b)) and w[3, "cc"] == pytest.approx(1)


def test_char_ngrams(spark):
    got = spark.createDataFrame([("ab c",)], "t string").select(vectorize.char_wb_ngrams(F.col("t"), 3, 4).alias("g")).first().g
    assert sorted(got) == sorted([" ab", "ab ", " ab ", " c "])


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=120) > 0.8).astype(float)
    weight = np.where(y == 1, 120 / (2 * y.sum()), 120 / (2 * (120 - y.sum())))
    z, w = np.hstack([x, np.ones((120, 1))]), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ (weight * (p - y)) + np.append(w[:3], 0)
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 1, 0]), g)
    df = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "label int, x array<double>").withColumn("features", array_to_vector("x"))
    m = models.logistic(df, tol=1e-10)
    assert np.abs(np.append(m.coefficients.toArray(), m.intercept) - w).max() < 1e-4


def test_nearest_edit(spark):
    words = ["hello world again", "short", "other words entirely", "x"]
    asked = ["hello wurld agaim", "shirt", "other words", "zzzzzzzzzzzzzzzzzzzz"]
    d = lambda c, xs: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {r.q: r.distance for r in relational.nearest_edit(d("q", asked), d("k", words), "q", "k", 3).collect()}
    assert got == {"hello wurld agaim": 2, "shirt": 1, "other words": 4, "zzzzzzzzzzzzzzzzzzzz": 4}


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(x,) for x in [1, 1, 1, 1, 1, 5, 9, 9]], "x int")
    assert {r.x: r.bin for r in aggregates.quantile_bins(df, "x").distinct().collect()}[1] == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"первая\nстрока"\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,t\n1,привет\n", encoding="cp1251")
    assert files.read_table(spark, str(tmp_path / "a.csv"), "id int, t string").first().t == "первая\nстрока"
    assert files.read_table(spark, str(tmp_path / "b.csv"), "id int, t string").first().t == "привет"
    profile = files.byte_profile(files.binary(spark, str(tmp_path / "b.csv"))).first()
    assert not profile.valid_utf8 and profile.high_share > 0
    files.write_submission(spark.createDataFrame([(2, 1), (1, 0)], "id int, label int"), str(tmp_path / "out"), ["id"], ["id", "label"])
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_bytes() == b"id,label\r\n1,0\r\n2,1\r\n"
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "pos int, y int")
    assert files.label_digest(df, "pos", "y").first().sha256 == "8a080cea809d1b9d33b541f3498b1b6366ffc66df75423108947085057cf2f99"


def test_cache_validation(spark):
    cache = spark.createDataFrame([(1, '{"prediction": 1}'), (1, '{"prediction": 1}'), (5, "broken")], "id int, raw_response string")
    got = {(r.id, r.problem) for r in files.validate_cache(spark.createDataFrame([(1,), (2,)], "id int"), cache).collect()}
    assert got == {(2, "missing"), (5, "unexpected"), (1, "duplicate"), (5, "malformed")}


def test_recurrence_leave_one_out(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 1)], "id int, k string, y int")
    r = {x.id: x for x in validation.recurrence_encoding(df, df, "k", "y", leave_one_out=True).collect()}
    assert (r[3].k_count, r[3].k_seen) == (0, 0) and r[3].k_rate == pytest.approx(2 / 3)
    assert r[1].k_rate == pytest.approx((0 + 10 * 2 / 3) / 11)

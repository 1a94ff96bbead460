"""What queries hold and move as tables grow: work dealt over tasks, rows shuffled, on small tables of one file."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sectiva.functions import titles
from sectiva.operators.design import Terms, design, fold_masks
from sectiva.operators.solver import Fit, held_out, solve
from sectiva.plans import applicability, catalog


@pytest.fixture
def moved(spark):
    """A function that runs a query's result and returns it with the records its stages wrote to shuffles."""

    def stages():
        gateway = spark.sparkContext._gateway
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    def run(df):
        before = set(stages())
        rows = df.collect()
        return rows, sum(n for k, n in stages().items() if k not in before)

    return run


def test_char_ngrams_moves_rows_not_pairs(spark, tmp_path, moved):
    names = [f"{a} {b}" for a in ("alpha beta", "gamma delta", "gamma") for b in ("omega", "sigma tau", "omega omega")]
    parts = [(k, names[k % len(names)]) for k in range(3000)] + [(7, "alpha rho"), (7, "alpha"), (8, None), (None, "alpha"), (None, "alpha tau"), (9, "")]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    n, ids = Counter(), {}
    for k, name in parts:
        for w in (name or "").split():
            for i in range(len(w)):
                term = f" {w} "[i : i + 3]
                n[term] += 1
                ids.setdefault(term, set()).update([] if k is None else [k])
    rows, records = moved(catalog.queries()["char_ngrams"](spark, str(tmp_path)))
    assert sorted((r.term, r.n, r.df) for r in rows) == sorted((t, n[t], len(ids[t])) for t in n)
    assert records < 3 * len(parts)


@pytest.mark.parametrize("name", ["record_presence", "masked_shapes", "invariant_tokens", "span_places", "negation_distances", "word_digests", "normalised_texts", "text_metadata", "word_bigrams"])
def test_rows_of_one_file_are_dealt_over_tasks(spark, tmp_path, name):
    spark.range(400).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("слово word "), F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()[name](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in got) == 400
    assert len(got) >= 4 and max(r["count"] for r in got) < 200


def test_marked_mass_moves_pairs_twice_at_most(spark, tmp_path, moved):
    docs = [(k, " ".join(f"w{(k + j) % 90}" for j in range(50))) for k in range(300)] + [(None, "w1 w2"), (300, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows, records = moved(catalog.queries()["marked_mass"](spark, str(tmp_path)))
    assert sorted((r.side, r.n, r.zero_rows) for r in rows if r.side is not None) == [(0, 151, 1), (1, 150, 0)]
    assert [(r.n, r.zero_rows) for r in rows if r.side is None] == [(1, 1)]
    assert records < 2.5 * 300 * 50


def test_equal_rows_are_packed_and_taken_apart_once(spark):
    rows = spark.range(600).select(
        "id", (F.col("id") % 2).cast("int").alias("label"), F.split(F.concat_ws(" ", F.lit("same words"), F.when(F.col("id") % 4 > 1, "more")), " ").alias("terms"), F.when(F.col("id") % 4 != 3, "a").alias("kind"),
        F.when(F.col("id") % 4 == 1, F.lit(-0.0)).when(F.col("id") % 4 == 2, F.lit(None)).otherwise(0.0).alias("x"), F.when(F.col("id") % 4 != 2, F.lit(1.5)).alias("z"), (F.floor(F.col("id") / 4) % 3).cast("int").alias("fold"),
    )
    rows = rows.unionByName(rows.limit(1).withColumns({"id": F.lit(600).cast("bigint"), "terms": F.lit(None).cast("array<string>")}))
    problem = design(rows.withColumns(fold_masks("fold", 3)), "id", "label", 3, [Terms("t", "terms")], ["kind"], ["x", "z"])
    assert problem.packed.select(F.explode("keys")).count() == 4 * 3 + 1
    fits = [Fit(g) for g in range(3)]
    got = held_out(problem, fits, solve(problem, fits)).collect()
    assert sorted(r.key for r in got) == list(range(601))
    assert all(r.fit == (r.key // 4 % 3 if r.key < 600 else 0) for r in got)
    assert len({(r.fit, r.key % 4, r.margin) for r in got if r.key < 600}) == 4 * 3
    assert problem.classes.sum() == 2 * 601


def test_invariant_tokens_parses_a_title_once(spark):
    titles_ = spark.createDataFrame([("Рекомендации\nВозраст: Дети\n# Лечение\n## abc (слово, 7 слов",), ("одна",), ("",), (None,)], "t string")
    got = titles_.select(titles.invariant_tokens(F.col("t")).alias("x"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("^[# ]+") == 1
    assert [r.x for r in got.collect()] == ["D2 AGE=???????: ???? NW4 LEN1 NL4 HASLATIN HASDIGIT w3 w7pc w1d w4", "D0 AGE= NW0 LEN0 NL3", "D0 AGE= NW0 LEN0 NL3", "D0 AGE= NW0 LEN0 NL3"]


def test_rows_of_one_title_are_one_row_of_the_design(spark, tmp_path, monkeypatch):
    spark.range(1500).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    dealt, designed = [], []
    folds, designs = applicability.stratified_folds, applicability.design
    monkeypatch.setattr(applicability, "stratified_folds", lambda df, *more: dealt.append(df) or folds(df, *more))
    monkeypatch.setattr(applicability, "design", lambda rows, *more, **named: designed.append(rows.count()) or designs(rows, *more, **named))
    got = {r.id: r for r in catalog.queries()["general_titles_oof"](spark, str(tmp_path)).collect()}
    assert not any(kind.startswith("array") for _, kind in dealt[0].dtypes)  # words and n-grams don't travel with rows
    assert designed[0] <= 3 * 120  # three folds of 120 titles
    rows = applicability.stage1_frame(catalog.formula_records(spark, str(tmp_path))).withColumn("label", F.col("title_text").contains("простаты").cast("int"))
    want = applicability.evaluate(rows, applicability.stage1_spec(), k=3).collect()
    assert len(want) == len(got) == 1500
    assert all((r.label, r.fold) == (got[r.id].label, got[r.id].fold) and abs(r.proba - got[r.id].proba) < 1e-6 for r in want)


def test_a_row_with_a_weight_is_as_many_rows(spark):
    rows = spark.range(40).select(
        "id", (F.col("id") % 2).cast("int").alias("label"), F.split(F.concat_ws(" ", F.lit("some"), F.concat(F.lit("w"), F.col("id") % 7)), " ").alias("terms"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("kind"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("x"), (F.col("id") % 4 / 4.0).alias("z"), (F.col("id") % 3).cast("int").alias("fold"), (1 + F.col("id") % 6).alias("times"),
    ).withColumns(fold_masks("fold", 3))
    apart = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).withColumn("id", F.col("id") * 10 + F.col("copy"))
    a, b = (design(df, "id", "label", 3, [Terms("t", "terms", 2, 5)], ["kind"], ["x", "z"], **more) for df, more in ((rows, {"weight": "times"}), (apart, {})))
    assert (a.classes == b.classes).all() and a.starts == b.starts and abs(a.scales - b.scales).max() < 1e-12
    assert all(abs(x - y).max() < 1e-9 for x, y in zip(a.numbers, b.numbers, strict=True))
    fits = [Fit(g) for g in range(3)]
    one, many = ({r.key: r.margin for r in held_out(p, fits, solve(p, fits)).collect()} for p in (a, b))
    assert len(one) == 40 and len(many) == apart.count()
    assert all(abs(one[k // 10] - m) < 1e-4 for k, m in many.items())


def test_texts_that_are_null_or_empty_are_scored(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "" if i % 5 == 1 else f"слово {i % 5}", int(i % 5 > 2)) for i in range(90)], "id bigint, t string, label int")
    got = applicability.evaluate_texts(rows, "t", lambda x: x.withColumn("words", F.split("t", " ")), applicability.Spec((applicability.TextBlock("t", "words"),)), k=3).collect()
    assert sorted(r.id for r in got) == list(range(90)) and all(0 < r.proba < 1 for r in got)
    assert len({(r.fold, r.id % 5) for r in got}) == len({(r.fold, r.id % 5, r.proba) for r in got})


@pytest.mark.parametrize("name", ["invariant_tokens", "masked_shapes", "title_parts", "title_structure", "skeletons"])
def test_a_title_of_many_rows_is_taken_apart_once(spark, tmp_path, monkeypatch, name):
    spark.range(3000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    want = catalog.queries()[name](spark, str(tmp_path)).collect()
    looked = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda s: looked.add(1) or s, "string")
    monkeypatch.setattr(titles, "text", lambda c: seen(F.coalesce(c, F.lit(""))))
    got = catalog.queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == 3000 and sorted(got) == sorted(want)
    assert 120 <= looked.value < 3000  # 120 titles; a plan may look at one more than once

"""Titles, records and condition matching on small fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from sectiva.functions import conditions, records, text, titles

TITLE = 'Клинические рекомендации "Болезнь Крона"\nВозрастная категория: Взрослые\n# Лечение\n## Консервативное лечение\n### Легкая БК илеоцекальной локализации'
RECORD = (
    "Код МКБ-10: K50.8\nПол: Женский\nВозраст: 34\nЖалобы: на боли, рвоты нет тошноты\nАнамнез: язвенный колит не выявлен\n"
    "Показатель: Hb, Результат: 120\nОбъективный статус: состояние удовлетворительное"
)


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "c string").select(*columns).first()


def c():
    return F.col("c")


def test_title_parts(spark):
    r = one(spark, TITLE, titles.parse_title(c()).alias("p")).p
    assert (r.depth, r.n_lines, r.body) == (3, 5, "Легкая БК илеоцекальной локализации")
    assert r.hierarchy == ["# Лечение", "## Консервативное лечение"]
    f = one(spark, TITLE, titles.struct_features(c())["n_quotes"].alias("q"), titles.struct_features(c())["has_latin"].alias("l"))
    assert (f.q, f.l) == (2, 0)


@pytest.mark.parametrize(("value", "guideline", "age", "body", "n"), [("one", "one", "", "", 3), ("a\n b ", "a", "b", "b", 3), ("", "", "", "", 3), (None, "", "", "", 3)])
def test_short_titles(spark, value, guideline, age, body, n):
    r = one(spark, value, titles.parse_title(c()).alias("p")).p
    assert (r.guideline, r.age_category, r.body, r.n_lines) == (guideline, age, body, n)


def test_record_fields(spark):
    r = one(spark, RECORD, *(x.alias(k) for k, x in records.record_fields(c()).items()), records.icd_code(c()).alias("icd"), records.clean_record(c()).alias("clean"))
    assert (r.gender_raw, r.age, r.icd, r.has_structured_header, r.negation_count) == ("F", 34.0, "K50.8", 1, 2)
    assert "Показатель" not in r.clean
    assert r.narrative_text == "на боли, рвоты нет тошноты язвенный колит не выявлен состояние удовлетворительное"


def test_records_without_headers(spark):
    r = one(spark, "Пациентка, 45 лет, без полей", *(x.alias(k) for k, x in records.record_fields(c()).items()))
    assert (r.gender_raw, r.age, r.narrative_text) == (None, 45.0, "Пациентка, 45 лет, без полей")
    assert one(spark, "Диагноз: I50.0 ХСН", records.icd_code(c()).alias("x")).x == "I50.0"
    assert one(spark, "нет кода", records.icd_code(c()).alias("x"), records.icd_category(records.icd_code(c())).alias("y"))[:] == ("NA", "NA")


def test_negations(spark):
    low = "травмы отрицает. без особенностей. жалоб нет."
    assert one(spark, low, text.negation_count(c()).alias("n")).n == 0
    r = one(spark, "отёков не выявлено, тест отрицательный", text.negation_spans(c()).alias("s")).s
    assert [(x.s, x.e) for x in r] == [(7, 18), (25, 38)]


def test_hits_overlap(spark):
    assert list(one(spark, "aaaa", text.hits(c(), F.lit("aa")).alias("h")).h) == [0, 1, 2]
    assert list(one(spark, "xab ab", text.hits(c(), F.lit("ab")).alias("h")).h) == [1, 4]
    assert list(one(spark, "xyz", text.hits(c(), F.lit("q")).alias("h")).h) == []


def test_conditions(spark):
    rows = [
        (1, "Лечение до 18 лет", ["лечение"], "x", ["x"], 34.0, "F"), (2, "Лечение до 18 лет", ["лечение"], "x", ["x"], None, "F"), (3, "эндометриоз", ["эндометриоз"], "x", ["x"], 20.0, None),
        (4, "рак простаты", ["простата"], "простата в норме", ["простата"], 20.0, "F"), (5, "лёгкий колит", ["лёгкий", "колит"], "колит не выявлен, тяжёлый", ["колит", "тяжёлый"], 20.0, "M"), (6, "терапия", ["терапия"], "x", ["x"], 20.0, "M"),
    ]
    df = spark.createDataFrame(rows, "id int, title_text string, title_lemma array<string>, narrative_text string, narrative_lemma array<string>, age double, gender_raw string")
    r = {x.id: x for x in conditions.contradiction_features(df).collect()}
    assert r[1].age_contradiction == 1 and r[2].age_contradiction == 0
    assert (r[3].gender_condition_present, r[3].gender_unknown) == (1, 1)
    assert (r[4].contradiction_count, r[4].condition_overlap) == (1, 1)
    assert (r[5].severity_contradiction, r[5].condition_contradiction, r[5].condition_overlap) == (1, 1, 1)
    assert r[6].contradiction_density == 0.0


def test_negation_geometry(spark):
    df = spark.createDataFrame([(["колит", "язва"], "колит не выявлен"), (["язва"], "без язв")], "terms array<string>, record string")
    a, b = conditions.negation_geometry(df, "terms", "record").collect()
    assert (a.nearest_negation_distance, a.neg_after_condition, a.neg_before_condition, a.neg_within_5, a.condition_tokens_matched) == (1.0, 1, 0, 1, "колит")
    assert b.nearest_negation_distance is None and b.neg_within_50 == 0


def test_lemmatise_keeps_order(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "id int, w array<string>")
    lemmas = spark.createDataFrame([("b", "B")], "token string, lemma string")
    assert {r.id: list(r.lemmas) for r in text.lemmatise(df, "id", "w", lemmas).collect()} == {1: ["B", "a", "B"], 2: []}

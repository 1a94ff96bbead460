"""The two stages against an independent fit, and what is built on them."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectiva.operators import decode, metrics, validation
from sectiva.plans import applicability
from sectiva.plans.applicability import Spec, TextBlock


@pytest.fixture(scope="module")
def rows(spark):
    words = "red green blue round flat tall short heavy light warm cold".split()
    rng = np.random.default_rng(4)
    data = []
    for i in range(120):
        terms = [words[k] for k in rng.integers(0, len(words), 6)]
        y = int(("red" in terms) + ("tall" in terms) - ("cold" in terms) + rng.normal(0, 0.5) > 0.4)
        data.append((i, terms, float(rng.normal()), "ab"[i % 2], y))
    return spark.createDataFrame(data, "id bigint, terms array<string>, x double, kind string, label int").cache()


SPEC = Spec((TextBlock("t", "terms", min_df=1),), ("x",), ("kind",), 1.0)


def newton(x, y, c):
    """Balanced L2 logistic regression with a free intercept."""
    w8 = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    x1, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1 / c] * x.shape[1] + [0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x1 @ w))
        step = np.linalg.solve((x1 * (w8 * p * (1 - p))[:, None]).T @ x1 + ridge, x1.T @ (w8 * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


def design(train, test):
    """TF-IDF, scaled number and levels, learned on ``train``, for rows of (id, terms, x, kind, label)."""
    vocabulary = sorted({t for r in train for t in r.terms})
    df = np.array([sum(t in r.terms for r in train) for t in vocabulary])
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    median = np.median([r.x for r in train])
    mean, sd = np.mean([r.x for r in train]), np.std([r.x for r in train])

    def one(r):
        tf = np.array([r.terms.count(t) for t in vocabulary]) * idf
        norm = np.linalg.norm(tf)
        return [*(tf / norm if norm else tf), ((median if r.x is None else r.x) - mean) / sd, float(r.kind == "a"), float(r.kind == "b")]

    return np.array([one(r) for r in train]), np.array([one(r) for r in test])


def test_out_of_fold_scores_equal_an_independent_fit(rows):
    got = {r.id: r for r in applicability.evaluate(rows, SPEC, k=3).collect()}
    local = rows.collect()
    assert len(got) == 120
    for k in range(3):
        train, test = [r for r in local if got[r.id].fold != k], [r for r in local if got[r.id].fold == k]
        a, b = design(train, test)
        w = newton(a, np.array([r.label for r in train]), SPEC.c)
        want = 1 / (1 + np.exp(-(b @ w[:-1] + w[-1])))
        assert np.allclose([got[r.id].proba for r in test], want, atol=2e-3)


def test_save_and_load(spark, rows, tmp_path):
    fitted = applicability.fit(rows, SPEC)
    fitted.save(str(tmp_path / "m"))
    again = applicability.Fitted.load(spark, str(tmp_path / "m"))
    assert again.spec == SPEC
    a, b = ({r.id: r.proba for r in f.score(rows).collect()} for f in (fitted, again))
    assert a == pytest.approx(b)


def test_nested_grid_and_compare(rows):
    nested = applicability.nested(rows, SPEC, k=2, inner=2)
    assert [i for i, *_ in nested] == [0, 1] and all(0.05 <= t <= 0.95 and 0 <= s <= 1 for _, t, s in nested)
    ranked = applicability.grid_search(rows, {"weak": replace(SPEC, c=0.001), "strong": replace(SPEC, c=10.0)}, "m2", k=2)
    assert [x[2] for x in ranked] == sorted((x[2] for x in ranked), reverse=True) and {x[0] for x in ranked} == {"weak", "strong"}
    deltas = applicability.compare(rows, SPEC, SPEC.without("numbers"), seeds=(0,), k=2).collect()
    assert len(deltas) == 2
    same = applicability.compare(rows, SPEC, SPEC, seeds=(0,), k=2).collect()
    assert all(r.delta == 0 for r in same)
    assert len(applicability.stage1_grid()) == 48 and set(applicability.CANDIDATES) >= {"B0", "C0", "D1"}


def test_decoded_frame(spark):
    titles = spark.createDataFrame([(1, 'Рекомендации "Грипп"\nВозраст: Взрослые\n# Лечение\n## Общее лечение'), (2, 'Рекомендации "Грипп"\nВозраст: Взрослые\n# Лечение\n## Общее лечение'), (3, 'Рекомендации "Корь"\nВозраст: Дети\n# Уход')], "id bigint, title_text string")
    index = decode.decoder("id", "title_text", train=titles, test=titles)
    assert index.filter("source is not null").count() == 0 and index.filter("clean = '# Уход'").first().n_sources == 2
    own = decode.line_index(titles, "id", "title_text")
    got = {r.id: r for r in applicability.decoded_frame(titles, decode.decode_titles(titles, own, "id", "title_text")).collect()}
    assert got[1].s_coverage == 1.0 and got[1].sub_terms and got[3].s_coverage == 0.0 and not got[3].sub_terms


def test_provenance_of_repeated_lines(spark):
    lines = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "x"), (4, "b", "x"), (5, None, "x")], "id bigint, line string, origin string")
    got = {r.id: (r.same_origin, r.other_origin) for r in decode.provenance(lines, lines, "id", "line", "origin").collect()}
    assert got == {1: (True, True), 2: (True, True), 3: (False, True), 4: (False, False), 5: (False, False)}


def test_metrics_of_the_stage(rows):
    oof = applicability.evaluate(rows, SPEC, k=2)
    assert metrics.auc(oof, "label", "proba").first().auc > 0.7
    assert oof.filter(F.col("proba").isNull()).count() == 0


def test_candidates_of_trees_copies_and_blends(spark):
    """C1 to C5: trees find a conjunction of a word and a category, copies an exclusive one; members blend."""
    rng = np.random.default_rng(8)
    data = []
    for i in range(240):
        word, kind = rng.integers(0, 2), rng.integers(0, 2)
        terms = ["red" if word else "blue"] + [f"w{int(k)}" for k in rng.integers(0, 6, 4)]
        data.append((i, f"title {kind}", terms, float(rng.normal()), f"k{kind}", int(word ^ kind), i % 3, int(word and kind)))
    rows = spark.createDataFrame(data, "id bigint, title_text string, full_lemma array<string>, x double, kind string, label int, own int, both int").cache()
    trees = applicability.tree_folds(rows, "own", 3, label="both", numbers=("x",), categories=("kind",), components=3, rounds=12, depth=3, rate=0.4)
    assert trees.count() == 240 and metrics.auc(trees, "both", "proba").first().auc > 0.8
    plain, copies = Spec((TextBlock("t", "full_lemma"),), (), ("kind",)), Spec((TextBlock("t", "full_lemma"), TextBlock("title_copies", "title_copies")), (), ("kind",))
    both = applicability.evaluate_folds(applicability.title_copies(rows), [plain, copies], "own", 3)
    areas = {r.spec: r.auc for r in metrics.auc(both, "label", "proba", ["spec"]).collect()}
    assert areas[0] < 0.7 and areas[1] > 0.95, "copies of a word for each title make the interaction linear"
    blend = validation.mean_blend(trees.select("id", "proba").unionByName(both.filter("spec = 1").select("id", "proba")), "id", "proba")
    assert blend.count() == 240 and {"C1", "C5_0.3", "C5_3"} <= set(applicability.CANDIDATES)

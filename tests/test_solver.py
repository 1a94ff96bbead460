"""Many fits at once against dense solves, exact quantiles and global order against numpy."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectiva.operators import aggregates, metrics, ordered, quantiles, solver, validation
from sectiva.operators.design import Terms, design, fold_masks
from sectiva.operators.solver import SQUARED_HINGE, Fit, held_out, solve
from sectiva.plans import applicability
from sectiva.plans.applicability import Spec, TextBlock

WORDS = "red green blue round flat tall short heavy light warm cold rare".split()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    data = []
    for i in range(150):
        terms = [WORDS[int(12 * rng.random() ** 2)] for _ in range(int(rng.integers(0, 9)))] or None
        x = None if rng.random() < 0.2 else float(rng.normal(2, 3))
        y = int((terms or []).count("red") - (terms or []).count("blue") + (x or 0) / 4 + rng.normal(0, 0.7) > 0.6)
        data.append((i, terms, x, float(i % 7), ["a", "b", None, "c"][int(rng.integers(0, 4))] if i != 3 else "only", y, int(rng.integers(0, 3))))
    return spark.createDataFrame(data, "id bigint, terms array<string>, x double, z double, kind string, label int, fold int").withColumns(fold_masks("fold", 3)).cache()


def dense(local, fold, min_df=2, most=None):
    """Training set ``fold``'s (rows x features) matrix of all rows: unit TF-IDF, levels, scaled numbers."""
    train = [r for r in local if r.fold != fold]
    counts = {t: (sum(t in (r.terms or []) for r in train), sum((r.terms or []).count(t) for r in train)) for t in WORDS}
    known = [t for t in WORDS if counts[t][0] >= min_df]
    if most:
        known = sorted(known, key=lambda t: (-counts[t][1], t))[:most]
    idf = {t: np.log((1 + len(train)) / (1 + counts[t][0])) + 1 for t in known}
    levels = sorted({r.kind for r in train if r.kind})
    values = [[r.x for r in train if r.x is not None], [r.z for r in train]]
    medians = [np.median(v) for v in values]
    filled = np.array([[medians[0] if r.x is None else r.x, r.z] for r in train])
    mean, sd = filled.mean(axis=0), filled.std(axis=0)
    out = []
    for r in local:
        tf = np.array([(r.terms or []).count(t) * idf[t] for t in known])
        norm = np.linalg.norm(tf)
        out.append([*(tf / norm if norm else tf), *(float(r.kind == v) for v in levels), *((np.array([medians[0] if r.x is None else r.x, r.z]) - mean) / sd)])
    return np.array(out)


def newton(x, y, c, loss, free=True):
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    x1, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1.0] * x.shape[1] + [0.0 if free else 1.0])
    value = lambda w: 0.5 * w @ ridge @ w + c * (weight * solver._loss(loss, x1 @ w, y)[0]).sum()
    for _ in range(300):
        _, slope, curve = solver._loss(loss, x1 @ w, y)
        g = c * x1.T @ (weight * slope) + ridge @ w
        step, t = np.linalg.solve(c * (x1 * (weight * curve)[:, None]).T @ x1 + ridge + 1e-12 * np.eye(len(w)), g), 1.0
        while value(w - t * step) > value(w) - 1e-4 * t * (g @ step) and t > 1e-9:
            t /= 2
        w = w - t * step
        if np.abs(step).max() < 1e-11:
            break
    return w


@pytest.fixture(scope="module")
def problem(rows):
    return design(rows, "id", "label", 3, [Terms("t", "terms")], ["kind"], ["x", "z"])


@pytest.mark.parametrize(("loss", "free"), [("log", True), ("squared_hinge", False), ("squared_hinge", True)])
def test_all_folds_and_strengths_equal_dense_solves(rows, problem, loss, free):
    local = rows.orderBy("id").collect()
    fits = [Fit(g, c, loss=loss, free=free) for g in range(3) for c in (0.1, 1.0, 30.0)]
    w = solve(problem, fits, tol=1e-9)
    got = {(r.fit, r.key): r.margin for r in held_out(problem, fits, w).collect()}
    assert len(got) == 3 * len(local)
    for k, f in enumerate(fits):
        x = dense(local, f.group)
        train = np.array([r.fold != f.group for r in local])
        want = newton(x[train], np.array([r.label for r in local])[train], f.c, loss, free)
        margins = x @ want[:-1] + want[-1]
        assert np.allclose([got[k, r.id] for r in local if r.fold == f.group], margins[~train], atol=2e-5)
        own = w[k][: problem.columns][problem.scales[:, f.group] > 0]
        assert np.allclose(np.sort(np.append(own, w[k][problem.columns :])), np.sort(want), atol=1e-5)


def test_weights_and_off_blocks_are_feature_scales(rows, problem):
    local = rows.orderBy("id").collect()
    fits = [Fit(1, 2.0, (("t", 0.5), ("kind", 0.0), ("numbers", 1.0)))]
    got = {r.key: r.margin for r in held_out(problem, fits, solve(problem, fits, tol=1e-9)).collect()}
    x = dense(local, 1)
    terms = int((problem.scales[:, 1][: problem.starts[1]] > 0).sum())
    x = np.hstack([0.5 * x[:, :terms], x[:, -2:]])
    train = np.array([r.fold != 1 for r in local])
    want = newton(x[train], np.array([r.label for r in local])[train], 2.0, "log")
    assert np.allclose([got[r.id] for r in local if r.fold == 1], (x @ want[:-1] + want[-1])[~train], atol=2e-5)


def test_most_frequent_terms_of_each_training_set(rows):
    local = rows.collect()
    got = design(rows, "id", "label", 3, [Terms("t", "terms", 2, 4)], [], [])
    for g in range(3):
        assert (got.scales[:, g] > 0).sum() == 4
        x = dense(sorted(local, key=lambda r: r.id), g, most=4)
        assert x.shape[1] >= 4
    fits = [Fit(g) for g in range(3)]
    scored = {(r.fit, r.key): r.margin for r in held_out(got, fits, solve(got, fits, tol=1e-9)).collect()}
    local.sort(key=lambda r: r.id)
    x, train = dense(local, 0, most=4)[:, :4], np.array([r.fold != 0 for r in local])
    want = newton(x[train], np.array([r.label for r in local])[train], 1.0, "log")
    assert np.allclose([scored[0, r.id] for r in local if r.fold == 0], (x @ want[:-1] + want[-1])[~train], atol=2e-5)


def test_solved_in_turns_and_summed_in_a_tree(rows, problem, monkeypatch):
    fits = [Fit(g, c) for g in range(3) for c in (0.5, 5.0)]
    whole = solve(problem, fits)
    monkeypatch.setattr(solver, "MOST_COEFFICIENTS", 2 * (problem.columns + problem.dense + 1))
    monkeypatch.setattr(solver, "FLAT", 0)
    monkeypatch.setattr(solver, "CHUNK", 7)
    assert np.allclose(solve(problem, fits), whole, atol=1e-4)


def test_one_class_and_no_rows(spark, rows):
    alone = design(rows.withColumn("label", F.lit(1)), "id", "label", 3, [Terms("t", "terms")], [], [])
    assert np.isfinite(solve(alone, [Fit(0)], max_steps=20)).all()
    none = design(rows.limit(0), "id", "label", 3, [Terms("t", "terms")], ["kind"], ["x"])
    assert none.columns == 0 and held_out(none, [Fit(0)], solve(none, [Fit(0)])).count() == 0


SPEC = Spec((TextBlock("t", "terms", min_df=1),), ("x", "z"), ("kind",), 1.0)


def test_nested_scores_equal_separate_evaluations(rows):
    plain = rows.select("id", "terms", "x", "z", "kind", "label")
    got = applicability.nested_scores(plain, [SPEC, replace(SPEC, c=10.0), SPEC.without("numbers")], k=2, inner=2).collect()
    assert {(r.spec, r.fold) for r in got} == {(s, f) for s in range(3) for f in range(2)}
    folded = applicability.stratified_folds(plain, "id", "label", 2, 0).cache()
    for i, spec in enumerate((SPEC, replace(SPEC, c=10.0), SPEC.without("numbers"))):
        train, test = folded.filter("fold <> 0").drop("fold"), folded.filter("fold = 0")
        t = applicability.best_threshold(applicability.sweep(applicability.evaluate(train, spec, k=2, seed=1), "label", "proba"), "m1").first()["threshold"]
        score = applicability.sweep(applicability.fit(train, spec).score(test), "label", "proba", [t]).first()
        own = next(r for r in got if (r.spec, r.fold) == (i, 0))
        assert own.threshold == pytest.approx(t) and own.m1 == pytest.approx(score["m1"])


def test_strengths_and_pooled_selection(rows):
    plain = rows.select("id", "terms", "x", "z", "kind", "label")
    by_strength = applicability.select_strength(plain, SPEC, (0.5, 5.0), k=2, inner=2)
    table = {r.c: r for r in applicability.pooled_selection(plain, SPEC, (0.5, 5.0), k=2, inner=2).collect()}
    assert list(by_strength) == [0.5, 5.0] == sorted(table)
    for c, score in by_strength.items():
        assert table[c]["mean"] == pytest.approx(score) and 0 <= table[c].pooled <= 1


def test_squared_hinge_specification(rows):
    got = applicability.evaluate(rows.select("id", "terms", "x", "z", "kind", "label"), replace(SPEC, loss=SQUARED_HINGE), k=3)
    assert got.count() == 150 and got.agg(F.min("proba")).first()[0] < 0


# ---- quantiles and order ----


@pytest.mark.parametrize("shares", [[0.5], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]])
def test_quantiles_equal_numpy(spark, shares):
    rng = np.random.default_rng(3)
    groups = {"wide": np.concatenate([rng.normal(0, 1, 300), 10.0 ** rng.uniform(-300, 300, 200), -(10.0 ** rng.uniform(-300, 300, 101))]), "ties": rng.integers(0, 4, 400).astype(float), "one": np.array([7.5]), "hot": np.full(500, -2.25), "near": 1 + np.arange(300) * 2.0**-52, "zeros": np.array([0.0, -0.0, 5e-324, -5e-324]), "huge": np.array([-1.7e308, 1.7e308, 0.0])}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("wide", None), (None, 1.0), (None, 3.0), ("nulls", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {r.g: r for r in quantiles.quantiles(df, "x", shares, ["g"]).collect()}
    assert set(got) == {*groups, None}
    for g, xs in groups.items():
        xs = np.sort(xs)
        for i, p in enumerate(shares):
            spot = p * (len(xs) - 1)
            a, b = float(xs[int(np.floor(spot))]), float(xs[int(np.ceil(spot))])
            assert got[g][f"q{i}"] == pytest.approx(a if a == b else a + (b - a) * (spot - np.floor(spot)), rel=1e-15, abs=0)
    assert got[None].q0 == np.quantile([1.0, 3.0], shares[0])
    alone = quantiles.quantiles(df.filter("g = 'wide'"), "x", shares).collect()
    assert len(alone) == 1 and alone[0].q0 == got["wide"].q0


def test_quantiles_of_odd_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (None,)], "x double")
    r = quantiles.quantiles(df, "x", [0.0, 1 / 3, 2 / 3, 1.0]).first()
    assert (r.q0, r.q1, r.q2) == (float("-inf"), 1.0, float("inf")) and np.isnan(r.q3)
    assert quantiles.quantiles(df.limit(0), "x", [0.5]).first().q0 is None
    assert quantiles.quantiles(df.limit(0).withColumn("g", F.lit(1)), "x", [0.5], ["g"]).count() == 0


def test_running_totals_over_ranges(spark):
    rng = np.random.default_rng(5)
    data = [(None if rng.random() < 0.05 else "ab"[int(rng.random() < 0.8)], int(rng.integers(0, 10**6)), int(rng.integers(-5, 9))) for _ in range(700)]
    df = spark.createDataFrame(data, "g string, k bigint, v bigint")
    got = ordered.running(ordered.ranged(df, "g", "k", "v", parts=9), ["k", "v"], {"upto": F.col("v"), "n": F.lit(1)}, ["g"])
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (str(r.g), r.n)):
        total, n, last = seen.get(r.g, (0, 0, (-1, 0)))
        seen[r.g] = (total + r.v, n + 1, (r.k, r.v))
        assert (r.upto, r.n) == seen[r.g][:2] and (r.k, r.v) >= last
    assert got.count() == 700 and got.select("_range").distinct().count() > 4


def test_dense_ranks(spark):
    df = spark.createDataFrame([(c,) for c in ("z", "é", "a", "b")], "c string")
    assert [(r.c, r.code) for r in ordered.dense_ranks(df, "c", "code").orderBy("code").collect()] == [("a", 0), ("b", 1), ("z", 2), ("é", 3)]


# ---- folds and areas that rest on them ----


def greedy(sizes, k):
    loads, at = [0] * k, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        j = min(range(k), key=lambda i: (loads[i], i))
        loads[j] += n
        at[name] = j
    return at, loads


def test_dealing_equal_groups_equals_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(200):
        k = int(rng.integers(1, 7))
        loads = [int(x) for x in rng.integers(0, 40, k)]
        size, n = int(rng.integers(1, 12)), int(rng.integers(1, 60))
        own, want = list(loads), []
        for _ in range(n):
            j = min(range(k), key=lambda i: (own[i], i))
            own[j] += size
            want.append(j)
        plan = validation.deal_equal(loads, size, n)
        got = [next(c[(r - a) % len(c)] for a, c in reversed(plan) if a <= r) for r in range(n)]
        assert got == want and loads == own and len(plan) <= k


@pytest.mark.parametrize("skew", [False, True])
def test_group_folds_equal_greedy_assignment(spark, skew):
    rng = np.random.default_rng(11)
    sizes = {f"g{i:03d}": int(rng.integers(1, 6)) for i in range(70)} | ({"hot": 400, "warm": 90} if skew else {})
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int").repartition(4)
    at, loads = greedy(sizes, 4)
    rows = validation.group_folds(df, "g", 4).collect()
    assert {(r.g, r.fold) for r in rows} == set(at.items()) and len(rows) == sum(sizes.values())
    assert [sum(r.fold == j for r in rows) for j in range(4)] == loads


def test_area_of_many_distinct_scores(spark):
    rng = np.random.default_rng(4)
    p, y = np.round(rng.random(3000), 3), rng.integers(0, 2, 3000)
    order = np.argsort(p)
    ranks = np.empty(3000)
    ranks[order] = np.arange(1, 3001)
    for v in np.unique(p):
        ranks[p == v] = ranks[p == v].mean()
    want = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    df = spark.createDataFrame([(float(a), int(b), None if i % 3 else "x") for i, (a, b) in enumerate(zip(p, y, strict=True))], "p double, y int, g string")
    got = metrics.auc(df, "y", "p").first()
    assert got.auc == pytest.approx(want, abs=1e-12) and got.n == 3000
    assert {r.g: r.n for r in metrics.auc(df, "y", "p", ["g"]).collect()} == {"x": 1000, None: 2000}
    assert metrics.auc(df.filter("y = 1"), "y", "p").first().auc is None


def test_joined_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "k string, v double")
    assert {(r.k, r.v, r.m) for r in aggregates.joined_mean(df, "k", "v", "m").collect()} == {("a", 1.0, 2.0), ("a", 3.0, 2.0), (None, 5.0, 5.0), ("b", None, None)}

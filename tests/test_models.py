"""Singular values against numpy, ordered boosting, reachable scores against enumeration, audits on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectiva.operators import aggregates, boosting, decode, metrics, relational, svd


def long(spark, a):
    rows = [(f"r{i}", f"t{j}", float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]]
    return spark.createDataFrame(rows, "row string, term string, weight double").repartition(3)


def test_singular_values_equal_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 25)) * (rng.random((60, 25)) < 0.3) * (0.8 ** np.arange(25))
    got = svd.truncated_svd(long(spark, a), "row", "term", 5)
    u, s, vt = np.linalg.svd(a)
    assert np.allclose(got.values, s[:5], rtol=1e-6)
    rows = {r.row: r.svd for r in got.rows.collect()}
    mine = np.array([rows.get(f"r{i}", [0.0] * 5) for i in range(60)])
    want = u[:, :5] * s[:5]
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-4)
    v = {r.term: r.v for r in got.terms.collect()}
    v = np.array([v.get(f"t{j}", [0.0] * 5) for j in range(25)])
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-8) and ((v**3).sum(axis=0) >= 0).all() and np.allclose(a @ v, mine, atol=1e-8)


def test_low_rank_and_empty_matrices(spark):
    a = np.outer([1.0, 2, 0, 3], [1.0, 0, 2]) + np.outer([0.0, 1, 1, 0], [0.0, 1, 0])
    got = svd.truncated_svd(long(spark, a), "row", "term", 9)
    assert np.allclose(got.values, np.linalg.svd(a)[1][:2]) and got.rows.count() == 4
    none = svd.truncated_svd(long(spark, a).filter("weight > 99"), "row", "term", 3)
    assert none.values == [] and none.rows.count() == 0 and none.terms.count() == 0


def curved(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    x, z, c = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 5, n)
    y = ((x * z > 0) ^ (c == 3)).astype(int)
    rows = [(i, float(x[i]), None if i % 17 == 0 else float(z[i]), f"c{c[i]}" if i % 23 else None, f"noise{i // 2}", int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, x double, z double, c string, noise string, y int")


def test_boosting_learns_interactions_and_is_deterministic(spark):
    df = curved(spark)
    train, test = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    model = boosting.ordered_boosting(train, "id", "y", ["x", "z"], ["c"], rounds=24, depth=3, rate=0.3)
    scored = test.join(boosting.boosted_scores(model, test, "id"), F.col("id") == F.col("key"))
    assert metrics.auc(scored, "y", "proba").first().auc > 0.9 and scored.count() == test.count()
    again = boosting.ordered_boosting(train.repartition(7), "id", "y", ["x", "z"], ["c"], rounds=4, depth=3, rate=0.3)
    assert [s for s, _ in again.trees] == [s for s, _ in model.trees[:4]]
    assert all(np.allclose(a[1], b[1], atol=1e-9) for a, b in zip(again.trees, model.trees, strict=False))


def test_a_noise_category_does_not_leak(spark):
    """Labels of a category of two rows each tell nothing of other rows; trees on it must not fit the rows that they were fitted on."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, f"n{i // 2}", int(v)) for i, v in enumerate(rng.integers(0, 2, 600))], "id bigint, noise string, y int")
    stats = boosting.ordered_statistics(df.withColumn("place", boosting.permuted("id", 0)), "noise", "y", "place", "stat")
    assert 0.4 < metrics.auc(stats, "y", "stat").first().auc < 0.6
    whole = df.join(df.groupBy("noise").agg(F.avg("y").alias("mean")), "noise")
    assert metrics.auc(whole, "y", "mean").first().auc > 0.8, "plain mean labels do leak"
    fresh = spark.createDataFrame([(i, f"n{i // 2}", int(v)) for i, v in enumerate(rng.integers(0, 2, 600))], "id bigint, noise string, y int")
    model = boosting.ordered_boosting(df, "id", "y", [], ["noise"], rounds=5, depth=2)
    got = fresh.join(boosting.boosted_scores(model, fresh, "id"), F.col("id") == F.col("key"))
    assert 0.38 < metrics.auc(got, "y", "proba").first().auc < 0.62


def test_statistics_of_rows_before(spark):
    rows = [(0.1, "a", 1), (0.2, "a", 0), (0.3, "b", 1), (0.4, "a", 1), (0.5, None, 1), (0.6, None, 0)]
    df = spark.createDataFrame(rows, "place double, c string, y int").repartition(3)
    got = {r.place: r.s for r in boosting.ordered_statistics(df, "c", "y", "place", "s").collect()}
    assert got == pytest.approx({0.1: 0.5, 0.2: 0.75, 0.3: 0.5, 0.4: 0.5, 0.5: 0.5, 0.6: 0.75})


def test_stretches_double():
    assert boosting.stretch(np.array([0.0, 0.003, 0.02, 0.26, 0.49, 0.5, 0.999])).tolist() == [0, 0, 2, 6, 6, 7, 7]
    model = boosting.Trees([], [], [], {})
    assert model.trees == []


def test_one_class_has_no_trees(spark):
    df = curved(spark, 60).withColumn("y", F.lit(1))
    model = boosting.ordered_boosting(df, "id", "y", ["x"], ["c"], rounds=3)
    assert model.trees == [] and {r.proba for r in boosting.boosted_scores(model, df, "id").collect()} == {0.5}


@pytest.mark.parametrize("beta", [0.5, 2.0])
def test_reachable_scores_equal_enumeration(spark, beta):
    rng = np.random.default_rng(1)
    targets = [(i, int(p), int(n), float(t) - 0.004, float(t) + 0.004) for i, (p, n, t) in enumerate(zip(rng.integers(0, 9, 30), rng.integers(0, 9, 30), rng.random(30), strict=True))]
    targets += [(99, 3, 4, 0.0, 1.0), (98, 3, 4, 1.0, 1.0), (97, 3, 4, 0.9999, 0.99999)]
    got = {(r.id, r.fn): (r.fp_from, r.fp_to) for r in metrics.reachable(spark.createDataFrame(targets, "id bigint, p bigint, n bigint, low double, high double"), "id", beta).collect()}
    b, want = beta * beta, {}
    for i, p, n, low, high in targets:
        for fn in range(p + 1):
            fps = []
            for fp in range(n + 1):
                one = lambda hit, alarm, miss: (1 + b) * hit / ((1 + b) * hit + b * miss + alarm) if (1 + b) * hit + b * miss + alarm else 0.0
                if low <= (one(p - fn, fp, fn) + one(n - fp, fn, fp)) / 2 <= high:
                    fps.append(fp)
            if fps:
                want[i, fn] = (fps[0], fps[-1])
                assert fps == list(range(fps[0], fps[-1] + 1))
    assert got == want and (97, 0) not in got and got[98, 0] == (0, 0)


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 18, 60)]
    df = spark.createDataFrame([(w,) for w in words], "w string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    got = {(r.q, r.k): r.d for r in relational.near_pairs(df, df, "w", "w", 2).collect()}
    assert got == {(a, b): distance(a, b) for a in set(words) for b in set(words) if distance(a, b) <= 2}


def test_fuzzy_simulation(spark):
    lines = spark.createDataFrame([("??? ab", "red ab"), ("??? ac", "red ac"), ("?? zzzzzzzzz", "no zzzzzzzzz"), ("twin", "twin one"), ("twin", "twin two")], "m string, c string")
    got = decode.fuzzy_simulation(lines, "m", "c", 2).collect()
    assert [(r.distance, r.n) for r in got] == [(1, 2)] and got[0].recall == 0.5 and got[0].jaccard == pytest.approx(1 / 3) and got[0].exact == 0


def test_marked_mass_and_duplicate_columns(spark):
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "?b", 0.5), (2, "a", 1.0)], "id bigint, term string, weight double")
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id bigint, side int")
    got = {r.side: (r.mass, r.active, r.zero_rows, r.n) for r in aggregates.marked_mass(weights, rows, "id", "side", F.col("term").contains("?")).collect()}
    assert got == {0: (0.5, 2.0, 0, 1), 1: (0.0, 0.5, 1, 2)}
    df = spark.createDataFrame([(1, 1, None, None, 1), (2, 2, None, None, 3)], "a int, b int, c int, d int, e int")
    assert {(r.feature, r.same_as) for r in aggregates.duplicate_columns(df, list("abcde")).collect()} == {("b", "a"), ("d", "c")}

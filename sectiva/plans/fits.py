"""Registered queries of fitted models, with SQL that fits the same models by unrolled Newton steps.

The SQL knows one number per row, scaled by the training rows, an intercept, and balanced classes; two equations are
solved in closed form each step.  Folds are residues of ids, so that SQL has them, too.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sectiva.operators import metrics
from sectiva.operators.boosting import boosted_scores, ordered_boosting
from sectiva.operators.lemmas import lemma_table
from sectiva.operators.solver import SQUARED_HINGE
from sectiva.operators.svd import truncated_svd
from sectiva.plans.applicability import Spec, evaluate_folds, nested_scores
from sectiva.plans.catalog import CLASS_COUNTS, JUDGED, fb, judged, register, scaled, table

STEPS = 25
NUMBER = Spec(numbers=("n_chars",))


def newton_sql(loss: str = "log", free: bool = True) -> str:
    """CTEs from r (g, c, k, x, y, train, test) to z (g, c, k, y, test, margin): a model for each g and c, fitted where train holds."""
    if loss == "log":
        slope, curve = "(1 / (1 + exp(-(a + b * z))) - y)", "(1 / (1 + exp(-(a + b * z)))) * (1 - 1 / (1 + exp(-(a + b * z))))"
    else:
        sign = "(2 * y - 1)"
        slope, curve = f"(-2 * {sign} * greatest(0, 1 - {sign} * (a + b * z)))", f"(CASE WHEN 1 - {sign} * (a + b * z) > 0 THEN 2.0 ELSE 0.0 END)"
    pull = "0" if free else "1"
    parts = [
        "s AS (SELECT g, c, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd, count(*) AS n, sum(y) AS p FROM r WHERE train GROUP BY g, c)",
        "t AS (SELECT r.*, (x - m) / sd AS z, CASE WHEN y = 1 THEN n / (2.0 * p) ELSE n / (2.0 * (n - p)) END AS w FROM r JOIN s USING (g, c))",
        "b0 AS (SELECT g, c, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM s)",
    ]
    for i in range(STEPS):
        parts.append(
            f"h{i} AS (SELECT g, c, any_value(a) AS a, any_value(b) AS b, c * sum(w * {slope}) + {pull} * any_value(a) AS ga, c * sum(w * {slope} * z) + any_value(b) AS gb, "
            f"c * sum(w * {curve}) + {pull} AS haa, c * sum(w * {curve} * z) AS hab, c * sum(w * {curve} * z * z) + 1 AS hbb FROM t JOIN b{i} USING (g, c) WHERE train GROUP BY g, c)"
        )
        parts.append(f"b{i + 1} AS (SELECT g, c, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM h{i})")
    parts.append(f"z AS (SELECT t.g, t.c, k, y, test, a + b * z AS margin FROM t JOIN b{STEPS} USING (g, c))")
    return ", ".join(parts)


FOLDED = "r AS (SELECT f.g, CAST(c.c AS DOUBLE) AS c, doc_id AS k, CAST(n_chars AS DOUBLE) AS x, quality AS y, doc_id % 3 <> f.g AS train, doc_id % 3 = f.g AS test FROM b, (SELECT unnest(range(3)) AS g) f, (SELECT unnest([{cs}]) AS c) c)"


def _folded(spark, d):
    return judged(spark, d).select("doc_id", "n_chars", F.col("quality").cast("int").alias("quality"), (F.col("doc_id") % 3).cast("int").alias("own_fold"))


@register("fold_strengths", f"WITH {JUDGED}, {FOLDED.format(cs='0.002, 0.1, 5.0')}, {newton_sql()} SELECT c, k AS doc_id, g AS fold, round(1 / (1 + exp(-margin)), 4) AS proba FROM z WHERE test")
def fold_strengths(spark, d):
    strengths = (0.002, 0.1, 5.0)
    got = evaluate_folds(_folded(spark, d), [replace(NUMBER, c=c) for c in strengths], "own_fold", 3, "doc_id", "quality", 1e-9)
    return got.select(F.element_at(F.array(*map(F.lit, strengths)), F.col("spec") + 1).alias("c"), "doc_id", F.col("fold").cast("bigint").alias("fold"), F.round("proba", 4).alias("proba"))


@register("fold_squared_hinge", f"WITH {JUDGED}, {FOLDED.format(cs='0.01, 1.0')}, {newton_sql('hinge', False)} SELECT c, k AS doc_id, round(margin, 4) AS margin FROM z WHERE test")
def fold_squared_hinge(spark, d):
    strengths = (0.01, 1.0)
    got = evaluate_folds(_folded(spark, d), [replace(NUMBER, c=c, loss=SQUARED_HINGE) for c in strengths], "own_fold", 3, "doc_id", "quality", 1e-9)
    return got.select(F.element_at(F.array(*map(F.lit, strengths)), F.col("spec") + 1).alias("c"), "doc_id", F.round("proba", 4).alias("margin"))


@register(
    "strength_grid",
    f"WITH {JUDGED}, {FOLDED.format(cs='0.002, 0.1, 5.0')}, {newton_sql()}, q AS (SELECT c, y AS quality, 1 / (1 + exp(-margin)) AS score FROM z WHERE test), th AS (SELECT unnest(range(5, 96)) / 100 AS t), "
    f"x AS (SELECT c, t, {CLASS_COUNTS.replace('pred = 1', 'score >= t').replace('pred = 0', 'score < t')} FROM q, th GROUP BY c, t) "
    f"SELECT c, round(t, 2) AS threshold, round({scaled(fb(2))}, 4) AS m2 FROM x QUALIFY row_number() OVER (PARTITION BY c ORDER BY round({scaled(fb(2))}, 12) DESC, round(abs(t - 0.5), 12), t) = 1",
)
def strength_grid(spark, d):
    strengths = (0.002, 0.1, 5.0)
    got = evaluate_folds(_folded(spark, d), [replace(NUMBER, c=c) for c in strengths], "own_fold", 3, "doc_id", "quality", 1e-9)
    best = metrics.best_threshold(metrics.sweep(got, "quality", "proba", by=["spec"]), "m2", ["spec"])
    return best.select(F.element_at(F.array(*map(F.lit, strengths)), F.col("spec") + 1).alias("c"), "threshold", F.round("m2", 4).alias("m2"))


@register(
    "nested_thresholds",
    f"WITH {JUDGED}, e AS (SELECT o AS g, o, -1 AS j FROM (SELECT unnest(range(3)) AS o) UNION ALL SELECT 3 + o * 2 + j, o, j FROM (SELECT unnest(range(3)) AS o), (SELECT unnest(range(2)) AS j)), "
    "r AS (SELECT e.g, CAST(0.1 AS DOUBLE) AS c, doc_id AS k, CAST(n_chars AS DOUBLE) AS x, quality AS y, doc_id % 3 <> o AND (j < 0 OR (doc_id // 3) % 2 <> j) AS train, CASE WHEN j < 0 THEN doc_id % 3 = o ELSE doc_id % 3 <> o AND (doc_id // 3) % 2 = j END AS test FROM b, e), "
    f"{newton_sql()}, q AS (SELECT e.o, e.j, y AS quality, 1 / (1 + exp(-margin)) AS score FROM z JOIN e USING (g) WHERE test), th AS (SELECT unnest(range(5, 96)) / 100 AS t), "
    f"x AS (SELECT o, j < 0 AS outer_, t, {CLASS_COUNTS.replace('pred = 1', 'score >= t').replace('pred = 0', 'score < t')} FROM q, th GROUP BY ALL), "
    f"w AS (SELECT o, t FROM x WHERE NOT outer_ QUALIFY row_number() OVER (PARTITION BY o ORDER BY round({scaled(fb(2))}, 12) DESC, round(abs(t - 0.5), 12), t) = 1) "
    f"SELECT CAST(x.o AS INT) AS fold, round(x.t, 2) AS threshold, round({scaled(fb(2))}, 4) AS m2, tp, fp, fn, tn FROM x JOIN w ON x.o = w.o AND x.t = w.t WHERE outer_",
)
def nested_thresholds(spark, d):
    rows = _folded(spark, d).withColumn("inside", (F.floor(F.col("doc_id") / 3) % 2).cast("int"))
    got = nested_scores(rows, [replace(NUMBER, c=0.1)], "doc_id", "quality", 3, 2, metric="m2", folds=("own_fold", "inside"))
    return got.select("fold", "threshold", F.round("m2", 4).alias("m2"), "tp", "fp", "fn", "tn")


# --- lemmas ---------------------------------------------------------------------------------------

ENDINGS = "tion|ing|ed|ly|er|es|en|ent|able"
#: Words of the texts; those whose digest begins with a digit are the dictionary, their lemmas the words without an ending.
_KNOWN = f"t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM documents), l AS (SELECT token, regexp_replace(token, '({ENDINGS})$', 'e') AS lemma FROM t WHERE md5(token) < 'a')"


@register(
    "guessed_lemmas",
    f"WITH {_KNOWN}, p AS (SELECT token, lemma, len(list_filter(range(1, least(length(token), length(lemma)) + 1), lambda i: substr(token, 1, i) = substr(lemma, 1, i))) AS p FROM l), "
    "e AS (SELECT token, substr(token, p + 1) AS strip, substr(lemma, p + 1) AS add_ FROM p), "
    "r AS (SELECT right(token, n) AS suffix, strip, add_, count(*) AS c FROM e, (SELECT CAST(unnest(range(0, 7)) AS INT) AS n) WHERE n <= length(token) AND n >= length(strip) GROUP BY ALL), "
    "b AS (SELECT suffix, strip, add_ FROM r QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY c DESC, strip, add_) = 1), "
    "u AS (SELECT t.token, n, right(t.token, n) AS suffix FROM t LEFT JOIN l ON t.token = l.token, (SELECT CAST(unnest(range(0, 7)) AS INT) AS n) WHERE l.token IS NULL AND n <= length(t.token)), "
    "g AS (SELECT token, strip, add_ FROM u JOIN b USING (suffix) QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC) = 1) "
    "SELECT token, lemma, true AS known FROM l UNION ALL SELECT token, coalesce(nullif(left(token, length(token) - length(strip)) || add_, ''), token), false FROM g",
)
def guessed_lemmas(spark, d):
    tokens = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"))).alias("token")).distinct()
    known = tokens.filter(F.md5("token") < "a").withColumn("lemma", F.regexp_replace("token", f"({ENDINGS})$", "e"))
    return lemma_table(tokens, known).withColumn("known", F.md5("token") < "a")


# --- decomposition, boosting, reachable scores -----------------------------------------------------


@register(
    "singular_values",
    "WITH a AS (SELECT source, lang, CAST(count(*) AS DOUBLE) AS w FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), g AS (SELECT x.lang AS a, y.lang AS b, sum(x.w * y.w) AS g FROM a x JOIN a y ON x.source = y.source GROUP BY ALL), "
    "r AS (SELECT source, sum(w * w) AS s FROM a GROUP BY source) SELECT 'squares' AS what, round((SELECT sum(w * w) FROM a), 3) AS value UNION ALL SELECT 'fourth powers', round((SELECT sum(g * g) FROM g), 3) UNION ALL SELECT 'longest row', round((SELECT max(s) FROM r), 3)",
)
def singular_values(spark, d):
    counts = table(spark, d, "documents").filter("lang is not null and source is not null").groupBy("source", "lang").agg(F.count("*").alias("weight"))
    got = truncated_svd(counts, "source", "lang", 64, oversample=0, iterations=2)
    longest = got.rows.agg(F.max(F.aggregate("svd", F.lit(0.0), lambda a, x: a + x * x)).alias("value")).select(F.lit("longest row").alias("what"), "value")
    sums = spark.createDataFrame([("squares", sum(x**2 for x in got.values)), ("fourth powers", sum(x**4 for x in got.values))], "what string, value double")
    return sums.unionByName(longest).withColumn("value", F.round("value", 3))


@register("boosted_scores")
def boosted_scores_query(spark, d):
    """Ordered boosting of quality labels on length, language and source, scores of every labelled document."""
    rows = judged(spark, d)
    model = ordered_boosting(rows, "doc_id", "quality", ["n_chars"], ["lang", "source"], rounds=8, depth=3)
    return boosted_scores(model, rows, "doc_id").select(F.col("key").alias("doc_id"), F.round("proba", 6).alias("proba"))


@register(
    "reachable_scores",
    f"WITH {JUDGED}, c AS (SELECT source, {CLASS_COUNTS} FROM b GROUP BY source), t AS (SELECT source, tp + fn AS p, tn + fp AS n, round({fb(2)}, 2) AS told FROM c), "
    "e AS (SELECT t.*, m AS fn, a AS fp, p - m AS tp, n - a AS tn FROM t, LATERAL (SELECT unnest(range(0, p + 1)) AS m), LATERAL (SELECT unnest(range(0, n + 1)) AS a)), "
    f"s AS (SELECT source, fn, fp FROM e WHERE {fb(2)} BETWEEN told - 0.00500001 AND told + 0.00500001) SELECT source, CAST(fn AS BIGINT) AS fn, CAST(min(fp) AS BIGINT) AS fp_from, CAST(max(fp) AS BIGINT) AS fp_to FROM s GROUP BY source, fn",
)
def reachable_scores(spark, d):
    c = metrics.scores(judged(spark, d), "quality", "pred", ["source"])
    told = F.round("macro_f2", 2)
    targets = c.select("source", (F.col("tp") + F.col("fn")).alias("p"), (F.col("tn") + F.col("fp")).alias("n"), (told - 0.00500001).alias("low"), (told + 0.00500001).alias("high"))
    return metrics.reachable(targets, "source")

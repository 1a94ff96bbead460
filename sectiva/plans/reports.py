"""Registered queries of evaluation reports, checks and decoding, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectiva.functions import text
from sectiva.operators import aggregates, decode, metrics, relational, validation, vectorize
from sectiva.plans.catalog import JUDGED, fb, judged, register, rounded, scaled, table

FOLDED = f"WITH {JUDGED}, f AS (SELECT *, CAST(doc_id % 5 AS INT) AS fold FROM b)"


def folded(spark, d):
    return judged(spark, d).withColumn("fold", (F.col("doc_id") % 5).cast("int"))


@register("varied_groups", "SELECT text AS title, count(*) AS n, count(DISTINCT source) AS n_values FROM documents GROUP BY text HAVING count(*) >= 2 AND count(DISTINCT source) >= 2")
def varied_groups(spark, d):
    return aggregates.varied(table(spark, d, "documents"), "text", "source").withColumnRenamed("text", "title")


_RATE = "SELECT '{f}' AS flag, '{k}' AS kind, round(avg(CASE WHEN {w} THEN {f} END), 6) AS rate, round(avg(CASE WHEN quality = pred THEN {f} END), 6) AS right_rate, round(avg(CASE WHEN {w} THEN {f} END) / nullif(avg(CASE WHEN quality = pred THEN {f} END), 0), 6) AS lift FROM g"
_KINDS = {"fn": "quality = 1 AND pred = 0", "fp": "quality = 0 AND pred = 1"}


@register("error_lift", f"WITH {JUDGED}, g AS (SELECT *, CAST(n_chars > 1000 AS INT) AS is_long, CAST(lang = 'en' AS INT) AS is_en FROM b) " + " UNION ALL ".join(_RATE.format(f=f, k=k, w=w) for f in ("is_long", "is_en") for k, w in _KINDS.items()))
def error_lift(spark, d):
    rows = judged(spark, d).withColumns({"is_long": text.flag(F.col("n_chars") > 1000), "is_en": text.flag(F.col("lang") == "en")})
    return rounded(aggregates.error_lift(rows, ["is_long", "is_en"], "quality", "pred"), "rate", "right_rate", "lift")


@register("suffixed_join", "SELECT a.doc_id, a.quality AS quality_x, b.quality AS quality_y FROM labels a JOIN (SELECT doc_id, toxic AS quality FROM labels) b USING (doc_id)")
def suffixed_join(spark, d):
    a = table(spark, d, "labels")
    return relational.suffixed_join(a.select("doc_id", "quality"), a.select("doc_id", F.col("toxic").alias("quality")), "doc_id")


@register("hard_override", f"WITH {JUDGED} SELECT doc_id, CASE WHEN n_chars < 200 THEN 0 WHEN lang = 'de' AND toxic = 1 THEN 1 ELSE pred END AS pred FROM b")
def hard_override(spark, d):
    return relational.hard_override(judged(spark, d), "pred", [(F.col("n_chars") < 200, 0), ((F.col("lang") == "de") & (F.col("toxic") == 1), 1)]).select("doc_id", "pred")


@register("label_differences", f"WITH {JUDGED} SELECT lang, pred AS a, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS b, count(*) AS n FROM b GROUP BY 1, 2, 3")
def label_differences(spark, d):
    rows = judged(spark, d)
    return relational.label_differences(rows, rows.withColumn("pred", relational.at_least(F.col("score"), 0.4)), "doc_id", "pred", ["lang"])


@register("coverage_by_role", "WITH p AS (SELECT p_brand AS role, CASE WHEN count(*) OVER (PARTITION BY regexp_replace(p_name, '[a-z]', '?', 'g')) = 1 THEN 1.0 ELSE 0.0 END AS u FROM part), r AS (SELECT role, count(*) AS n, avg(u) AS c FROM p GROUP BY role) SELECT role, n, round(c, 6) AS coverage, round((SELECT max(c) - min(c) FROM r), 6) AS gap FROM r")
def coverage_by_role(spark, d):
    parts = table(spark, d, "part").withColumn("masked", F.regexp_replace("p_name", "[a-z]", "?"))
    alone = parts.groupBy("masked").agg((F.count("*") == 1).cast("int").alias("u"))
    return rounded(aggregates.coverage_by_role(parts.join(alone, "masked").withColumnRenamed("p_brand", "role"), "role", "u"), "coverage", "gap")


@register(
    "provenance",
    "WITH l AS (SELECT DISTINCT p_partkey AS id, p_brand AS origin, unnest(string_split(p_name, ' ')) AS line FROM part) "
    "SELECT a.id, bool_or(coalesce(b.origin = a.origin, false)) AS same_origin, bool_or(coalesce(b.origin <> a.origin, false)) AS other_origin FROM l a LEFT JOIN l b ON a.line = b.line AND a.id <> b.id GROUP BY a.id",
)
def provenance(spark, d):
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("origin"), F.explode(F.split("p_name", " ")).alias("line"))
    return decode.provenance(lines, lines, "id", "line", "origin")


@register(
    "decoded_without_self",
    "WITH l AS (SELECT p_partkey AS id, p_name AS clean, regexp_replace(p_name, '[a-z]', '?', 'g') AS masked FROM part), i AS (SELECT masked, clean, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS source FROM l GROUP BY masked, clean), "
    "h AS (SELECT l.id, l.masked, CASE WHEN i.source IS NULL OR i.source <> l.id THEN i.clean END AS c FROM l LEFT JOIN i USING (masked)) SELECT id, count(DISTINCT c) AS n_candidates, count(DISTINCT c) > 1 AS ambiguous FROM h GROUP BY id, masked",
)
def decoded_without_self(spark, d):
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("clean"), F.regexp_replace("p_name", "[a-z]", "?").alias("masked"))
    index = lines.groupBy("masked", "clean").agg(F.when(F.count_distinct("id") == 1, F.min("id")).alias("source"))
    return decode.decode_lines(lines, index, "id", "masked").select("id", F.col("n_candidates").cast("long").alias("n_candidates"), "ambiguous")


_AUC = "SELECT (sum(r) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)) FROM (SELECT quality, CASE WHEN quality = 1 THEN rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 ELSE 0 END AS r FROM f)"
_SUMMARY = (
    f"{FOLDED}, c AS (SELECT fold, count(*) FILTER (quality = 1 AND pred = 1) AS tp, count(*) FILTER (quality = 0 AND pred = 1) AS fp, count(*) FILTER (quality = 1 AND pred = 0) AS fn, count(*) FILTER (quality = 0 AND pred = 0) AS tn FROM f GROUP BY fold), "
    f"m AS (SELECT *, {scaled(fb(2.0))} AS m2 FROM c), g AS (SELECT source, count(*) AS n, min(pred) AS a, max(pred) AS z FROM f GROUP BY source) "
    f"SELECT round(avg(m2), 6) AS m2_mean, round(stddev_samp(m2), 6) AS m2_sd, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, round(({_AUC}), 6) AS auc, (SELECT count(*) FROM g WHERE n > 1 AND a = z) AS collapsed, round((SELECT avg(pred) FROM f), 6) AS positive_rate FROM m"
)


@register("summarise", _SUMMARY)
def summarise(spark, d):
    return rounded(validation.summarise(folded(spark, d), "quality", "pred", "score", "fold", "source"), "m2_mean", "m2_sd", "auc", "positive_rate")


@register("reproduced", f"WITH {JUDGED} SELECT x.metric, round(x.value, 6) AS value, x.expected, x.ok FROM (SELECT unnest([{{'metric': 'n', 'value': CAST(count(*) AS DOUBLE), 'expected': 399.0::DOUBLE, 'ok': abs(count(*) - 399) <= 0.5}}, {{'metric': 'rate', 'value': avg(pred), 'expected': 0.5::DOUBLE, 'ok': abs(avg(pred) - 0.5) <= 0.5}}, {{'metric': 'none', 'value': NULL, 'expected': 1.0::DOUBLE, 'ok': false}}]) AS x FROM b)")
def reproduced(spark, d):
    row = judged(spark, d).agg(F.count("*").alias("n"), F.avg("pred").alias("rate"), F.lit(None).cast("double").alias("none"))
    return rounded(validation.reproduced(row, {"n": 399, "rate": 0.5, "none": 1.0}, 0.5), "value")


@register(
    "submission_checks",
    f"WITH {JUDGED} SELECT count(*) AS n_rows, 0::BIGINT AS missing, 0::BIGINT AS unknown, count(*) FILTER (doc_id % 7 = 0) AS moved, 0::BIGINT AS not_binary, count(*) FILTER (lang = 'en' AND pred <> CASE WHEN score >= 0.4 THEN 1 ELSE 0 END) AS changed FROM b",
)
def submission_checks(spark, d):
    rows = judged(spark, d).withColumn("pos", F.col("doc_id"))
    template = rows.select("doc_id", F.when(F.col("doc_id") % 7 == 0, -1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"))
    shipped = rows.select("doc_id", relational.at_least(F.col("score"), 0.4).alias("pred"))
    return validation.submission_checks(rows.select("doc_id", "pos", "lang", "pred"), template, shipped, ["doc_id"], "pos", "pred", F.coalesce(F.col("lang") == "en", F.lit(False)))


_H = "(SELECT -sum(n / t * log2(n / t)) FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS t FROM g GROUP BY {0}))"
_I = lambda *k: f"({_H.format(', '.join(k))} + {_H.format('quality')} - {_H.format(', '.join((*k, 'quality')))})"
_PAIRS = (("lang", "toxic"), ("lang", "pred"), ("toxic", "pred"))


@register("synergies", f"WITH {JUDGED}, g AS (SELECT lang, toxic, pred, quality FROM b) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_I(a, b)} - {_I(a)} - {_I(b)}, 6) AS synergy" for a, b in _PAIRS))
def synergies(spark, d):
    return rounded(aggregates.synergies(judged(spark, d), ["lang", "toxic", "pred"], "quality"), "synergy")


@register(
    "cross_fitted_centering",
    f"{FOLDED}, p AS (SELECT source, fold, count(*) AS n, sum(score) AS s FROM f GROUP BY source, fold), o AS (SELECT p.source, p.fold, (SELECT coalesce(sum(n), 0) FROM p q WHERE q.source = p.source AND q.fold <> p.fold) AS gn, "
    "(SELECT coalesce(sum(s), 0) FROM p q WHERE q.source = p.source AND q.fold <> p.fold) AS gs, (SELECT sum(s) / sum(n) FROM p q WHERE q.fold <> p.fold) AS m FROM p) "
    "SELECT f.doc_id, round(greatest(0, least(1, f.score - CASE WHEN gn > 0 THEN (gs / gn - m) * gn / (gn + 5.0) ELSE 0 END)), 6) AS centred FROM f JOIN o USING (source, fold)",
)
def cross_fitted_centering(spark, d):
    return rounded(validation.cross_fitted_centering(folded(spark, d), "source", "score").select("doc_id", "centred"), "centred")


@register(
    "tfidf_top_terms",
    "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS w FROM documents), v AS (SELECT w AS term, count(DISTINCT doc_id) AS df, count(*) AS n FROM t GROUP BY w HAVING count(DISTINCT doc_id) >= 2 ORDER BY n DESC, term LIMIT 200) "
    "SELECT term, df, round(ln((1 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1, 6) AS idf FROM v",
)
def tfidf_top_terms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0)), F.array().cast("array<string>")).alias("w"))
    return vectorize.TfIdf.fit(docs, "doc_id", "w", 2, 200).vocabulary.withColumn("idf", F.round("idf", 6)).select("term", "df", "idf")


@register("class_scores_by_language", f"WITH {JUDGED}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 AND pred = 1) AS tp, count(*) FILTER (quality = 0 AND pred = 1) AS fp, count(*) FILTER (quality = 1 AND pred = 0) AS fn, count(*) FILTER (quality = 0 AND pred = 0) AS tn FROM b GROUP BY lang) SELECT lang, round({fb(2.0)}, 6) AS macro_f2 FROM c")
def class_scores_by_language(spark, d):
    return rounded(metrics.scores(judged(spark, d), "quality", "pred", ["lang"]).select("lang", F.col("macro_f2")), "macro_f2")

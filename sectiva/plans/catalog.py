"""The registered queries over the driver's tables and their SQL equivalents.

Records and titles are written by formula from ``customer`` keys, parsed by the library, and
compared with the formula itself in SQL; everything else runs on the tables as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectiva.functions import conditions, records, text, titles
from sectiva.operators import aggregates, decode, metrics, relational, validation, vectorize
from sectiva.sources.stages import written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over as many tasks as a shuffle has, evenly or by hash: a file of few narrow rows is read by one task, however much is computed on each."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a formula score and its prediction; texts are not read."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(table(spark, d, "labels"), "doc_id")
    return rows.withColumn("score", F.col("n_chars") % 1000 / F.lit(1000.0)).withColumn("pred", relational.at_least(F.col("score"), 0.5))


JUDGED = """b AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score,
  CASE WHEN CAST(d.n_chars % 1000 AS DOUBLE) / 1000 >= 0.5 THEN 1 ELSE 0 END AS pred FROM documents d JOIN labels l USING (doc_id))"""
CLASS_COUNTS = "count(*) AS n, count(*) FILTER (quality = 1 AND pred = 1) AS tp, count(*) FILTER (quality = 0 AND pred = 1) AS fp, count(*) FILTER (quality = 1 AND pred = 0) AS fn, count(*) FILTER (quality = 0 AND pred = 0) AS tn"


def fb(beta: float) -> str:
    b = beta * beta
    one = lambda tp, fp, fn: f"coalesce({1 + b} * {tp} / nullif({1 + b} * {tp} + {b} * {fn} + {fp}, 0), 0)"
    return f"(({one('tp', 'fp', 'fn')} + {one('tn', 'fn', 'fp')}) / 2)"


def scaled(x: str) -> str:
    return f"greatest(0, least(1, ({x} - 0.5) / 0.45))"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- metrics -------------------------------------------------------------------------------------


@register("flagship_rule_score", f"WITH {JUDGED}, c AS (SELECT lang, {CLASS_COUNTS} FROM b GROUP BY lang) SELECT lang, n, tp, fp, fn, tn, round({fb(0.5)}, 6) AS macro_f05, round({fb(2)}, 6) AS macro_f2, round({scaled(fb(0.5))}, 6) AS m1, round({scaled(fb(2))}, 6) AS m2 FROM c")
def flagship_rule_score(spark, d):
    return rounded(metrics.scores(judged(spark, d), "quality", "pred", ["lang"]), "macro_f05", "macro_f2", "m1", "m2")


@register(
    "class_report",
    f"WITH {JUDGED}, c AS (SELECT {CLASS_COUNTS} FROM b) SELECT 0 AS class, round(tn / nullif(tn + fn, 0), 6) AS precision, round(tn / nullif(tn + fp, 0), 6) AS recall, round(2.0 * tn / (2 * tn + fn + fp), 6) AS f, tn + fp AS support FROM c "
    "UNION ALL SELECT 1, round(tp / nullif(tp + fp, 0), 6), round(tp / nullif(tp + fn, 0), 6), round(2.0 * tp / (2 * tp + fn + fp), 6), tp + fn FROM c",
)
def class_report(spark, d):
    return rounded(metrics.class_report(judged(spark, d), "quality", "pred"), "precision", "recall", "f")


AUC = "SELECT {k}, round(sum(CASE WHEN y = 1 THEN r END) / nullif(n1 * n0, 0) - (n1 + 1) / nullif(2.0 * n0, 0), 6) AS auc, n1 + n0 AS n FROM (SELECT {k}, quality AS y, (rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0) AS r, count(*) FILTER (quality = 1) OVER (PARTITION BY {k}) AS n1, count(*) FILTER (quality = 0) OVER (PARTITION BY {k}) AS n0 FROM b) GROUP BY {k}, n1, n0"


@register("auc_by_source", f"WITH {JUDGED} {AUC.format(k='source')}")
def auc_by_source(spark, d):
    return rounded(metrics.auc(judged(spark, d), "quality", "score", ["source"]), "auc")


@register("auc_summary", f"WITH {JUDGED}, a AS ({AUC.format(k='lang').replace('round(', '(').replace(', 6)', ')')}) SELECT round(avg(auc), 6) AS mean, round(median(auc), 6) AS median, round(sum(auc * n) / sum(n) FILTER (auc IS NOT NULL), 6) AS weighted, count(*) FILTER (auc < 0.5) AS below_half, count(*) FILTER (auc IS NULL) AS one_class FROM a")
def auc_summary(spark, d):
    return rounded(metrics.weighted_auc(judged(spark, d), "quality", "score", "lang"), "mean", "median", "weighted")


SWEEP = f"s AS (SELECT t, {CLASS_COUNTS.replace('pred = 1', 'score >= t').replace('pred = 0', 'score < t')} FROM b, (SELECT unnest(range(5, 96)) / 100 AS t) GROUP BY t)"


@register("threshold_sweep", f"WITH {JUDGED}, {SWEEP} SELECT round(t, 2) AS threshold, tp, fp, fn, tn, round({scaled(fb(0.5))}, 6) AS m1, round({scaled(fb(2))}, 6) AS m2, round((tp + fp) / n, 6) AS positive_rate FROM s")
def threshold_sweep(spark, d):
    return rounded(metrics.sweep(judged(spark, d), "quality", "score"), "m1", "m2", "positive_rate").withColumn("threshold", F.round("threshold", 2))


@register("best_threshold", f"WITH {JUDGED}, {SWEEP}, m AS (SELECT round(t, 2) AS threshold, {scaled(fb(2))} AS m2 FROM s) SELECT threshold, round(m2, 6) AS m2 FROM m ORDER BY round(m2, 12) DESC, round(abs(threshold - 0.5), 12), threshold LIMIT 1")
def best_threshold(spark, d):
    return rounded(metrics.best_threshold(metrics.sweep(judged(spark, d), "quality", "score"), "m2"), "m2").withColumn("threshold", F.round("threshold", 2))


@register("rate_cut", f"WITH {JUDGED}, c AS (SELECT min(score) AS cut FROM (SELECT score FROM b ORDER BY score DESC LIMIT 50)) SELECT count(*) FILTER (score >= cut) AS kept, count(*) AS n FROM b, c")
def rate_cut(spark, d):
    return metrics.rate_cut(judged(spark, d), "score", 50).agg(F.sum("pred").alias("kept"), F.count("*").alias("n"))


@register("matching_threshold", f"WITH {JUDGED}, {SWEEP.replace('quality', 'pred')} SELECT round(t, 2) AS threshold, tp + tn AS equal, fp + fn AS differ FROM s ORDER BY tp + tn DESC, round(abs(t - 0.5), 12), t LIMIT 1")
def matching_threshold(spark, d):
    return metrics.matching_threshold(judged(spark, d), "score", "pred").withColumn("threshold", F.round("threshold", 2))


# --- aggregates ----------------------------------------------------------------------------------


@register("value_shares", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang")
def value_shares(spark, d):
    return rounded(aggregates.value_shares(table(spark, d, "documents").select("lang"), "lang"), "share")


@register("crosstab_shares", f"WITH {JUDGED} SELECT lang, round(count(*) FILTER (quality = 0) / count(*), 6) AS quality_0, round(count(*) FILTER (quality = 1) / count(*), 6) AS quality_1, count(*) AS n FROM b GROUP BY lang")
def crosstab_shares(spark, d):
    return rounded(aggregates.crosstab(judged(spark, d), "lang", "quality", [0, 1], shares=True), "quality_0", "quality_1")


@register("confusion", f"WITH {JUDGED} SELECT quality, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1, count(*) AS n FROM b GROUP BY quality")
def confusion(spark, d):
    return aggregates.crosstab(judged(spark, d), "quality", "pred", [0, 1])


@register("describe_lengths", "SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, min(n_chars) AS least, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, max(n_chars) AS most FROM documents")
def describe_lengths(spark, d):
    return rounded(aggregates.describe(table(spark, d, "documents"), "n_chars"), "mean", "sd", "p50", "p90")


@register("group_rates", f"WITH {JUDGED} SELECT source, count(*) AS n, round(avg(quality), 6) AS rate FROM b GROUP BY source")
def group_rates(spark, d):
    return rounded(aggregates.group_rates(judged(spark, d), "source", "quality"), "rate")


@register("pure_share", f"WITH {JUDGED}, g AS (SELECT n_chars, min(quality) = max(quality) AS p FROM b GROUP BY n_chars) SELECT round(avg(CAST(p AS INT)), 6) AS pure_share, count(*) AS groups FROM g")
def pure_share(spark, d):
    return rounded(aggregates.pure_share(judged(spark, d), "n_chars", "quality"), "pure_share")


@register("duplicate_texts", "SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_duplicates FROM documents")
def duplicate_texts(spark, d):
    return aggregates.duplicates(table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), "h")


@register("error_rates", f"WITH {JUDGED} SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 AND pred = 0) AS fn, count(*) FILTER (quality = 0 AND pred = 1) AS fp, round(avg(pred), 6) AS positive_rate FROM b GROUP BY lang")
def error_rates(spark, d):
    return rounded(aggregates.error_rates(judged(spark, d), ["lang"], "quality", "pred"), "positive_rate")


@register("states_table", f"WITH {JUDGED} SELECT 'long' AS state, count(*) FILTER (n_chars > 1000) AS n, round(avg(quality) FILTER (n_chars > 1000), 6) AS rate FROM b UNION ALL SELECT 'english', count(*) FILTER (lang = 'en'), round(avg(quality) FILTER (lang = 'en'), 6) FROM b UNION ALL SELECT 'all rows', count(*), round(avg(quality), 6) FROM b")
def states_table(spark, d):
    states = {"long": F.col("n_chars") > 1000, "english": F.col("lang") == "en", "all rows": F.lit(True)}
    return rounded(aggregates.states_table(judged(spark, d), states, "quality"), "rate")


LIFT = "SELECT '{f}' AS flag, round(avg({c}) FILTER (quality <> pred), 6) AS wrong_rate, round(avg({c}) FILTER (quality = pred), 6) AS right_rate, round(avg({c}) FILTER (quality <> pred) / nullif(avg({c}) FILTER (quality = pred), 0), 6) AS lift FROM b"


@register("flag_lift", f"WITH {JUDGED} {LIFT.format(f='is_long', c='CAST(n_chars > 1000 AS INT)')} UNION ALL {LIFT.format(f='is_en', c=chr(67) + 'AST(lang = ' + chr(39) + 'en' + chr(39) + ' AS INT)')}")
def flag_lift(spark, d):
    rows = judged(spark, d).withColumns({"is_long": text.flag(F.col("n_chars") > 1000), "is_en": text.flag(F.col("lang") == "en")})
    return rounded(aggregates.flag_lift(rows, ["is_long", "is_en"], F.col("quality") != F.col("pred")), "wrong_rate", "right_rate", "lift")


@register("category_table", f"WITH {JUDGED} SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 6) AS share, round(median(score), 6) AS median, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.9), 6) AS p90, round(avg(score), 6) AS mean FROM b GROUP BY lang")
def category_table(spark, d):
    return rounded(aggregates.category_table(judged(spark, d), "lang", "score"), "share", "median", "p10", "p90", "mean")


@register("all_missed", f"WITH {JUDGED} SELECT n_chars, count(*) AS positives FROM b WHERE quality = 1 GROUP BY n_chars HAVING bool_and(pred = 0)")
def all_missed(spark, d):
    return aggregates.all_missed(judged(spark, d), "n_chars", "quality", "pred")


@register("between_share", f"WITH {JUDGED}, m AS (SELECT score, avg(score) OVER (PARTITION BY source) AS g FROM b) SELECT round(var_pop(g) / var_pop(score), 6) AS between_share FROM m")
def between_share(spark, d):
    return rounded(aggregates.between_share(judged(spark, d), "source", "score"), "between_share")


@register("group_correlation", f"WITH {JUDGED}, g AS (SELECT source, avg(score) AS a, avg(quality) AS q FROM b GROUP BY source) SELECT round(corr(a, q), 6) AS r FROM g")
def group_correlation(spark, d):
    return rounded(aggregates.group_correlation(judged(spark, d), "source", "score", "quality"), "r")


def _h(keys: str) -> str:
    return f"(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / (SELECT count(*) FROM b) AS p FROM b GROUP BY {keys}))"


@register("mutual_information", f"WITH {JUDGED} SELECT round({_h('lang')} + {_h('quality')} - {_h('lang, quality')}, 6) AS bits")
def mutual_information(spark, d):
    return rounded(aggregates.mutual_information(judged(spark, d), ["lang"], "quality"), "bits")


@register("synergy", f"WITH {JUDGED} SELECT round(ab - a - x, 6) AS synergy, round(ab, 6) AS ab, round(a, 6) AS a, round(x, 6) AS b FROM (SELECT {_h('lang, toxic')} + {_h('quality')} - {_h('lang, toxic, quality')} AS ab, {_h('lang')} + {_h('quality')} - {_h('lang, quality')} AS a, {_h('toxic')} + {_h('quality')} - {_h('toxic, quality')} AS x)")
def synergy(spark, d):
    return rounded(aggregates.synergy(judged(spark, d), "lang", "toxic", "quality"), "synergy", "ab", "a", "b")


@register("score_histogram", f"WITH {JUDGED} SELECT CAST(least(floor(score * 10) + 1, 10) AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY 1")
def score_histogram(spark, d):
    return aggregates.histogram(judged(spark, d), "score")


@register("weighted_mean", f"WITH {JUDGED} SELECT round(sum(score * n_chars) / sum(n_chars), 6) AS weighted_mean FROM b")
def weighted_mean(spark, d):
    return rounded(aggregates.weighted_mean(judged(spark, d), "score", "n_chars"), "weighted_mean")


@register("mean_spread", f"WITH {JUDGED} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd0, round(stddev_samp(score), 6) AS sd1 FROM b")
def mean_spread(spark, d):
    return rounded(aggregates.mean_spread(judged(spark, d), "score"), "mean", "sd0", "sd1")


@register("common_lengths", "SELECT n_chars, count(*) AS n FROM documents GROUP BY n_chars ORDER BY n DESC, n_chars LIMIT 3")
def common_lengths(spark, d):
    return aggregates.common_values(table(spark, d, "documents"), "n_chars")


@register("recurrence_histogram", "SELECT times, count(*) AS keys FROM (SELECT count(*) AS times FROM documents GROUP BY text) GROUP BY times")
def recurrence_histogram(spark, d):
    return aggregates.count_histogram(table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), "h")


SMD = "SELECT '{c}' AS feature, round(abs(avg({c}) FILTER (toxic = 0) - avg({c}) FILTER (toxic = 1)) / coalesce(nullif(sqrt((var_pop({c}) FILTER (toxic = 0) + var_pop({c}) FILTER (toxic = 1)) / 2), 0), 1), 6) AS smd FROM b"


@register("drift", f"WITH {JUDGED} {SMD.format(c='n_chars')} UNION ALL {SMD.format(c='score')}")
def drift(spark, d):
    return rounded(aggregates.drift(judged(spark, d), "toxic", ["n_chars", "score"]), "smd")


@register("coverage_gap", f"WITH {JUDGED}, r AS (SELECT avg(CAST(n_chars > 500 AS INT)) FILTER (toxic = 0) AS a, avg(CAST(n_chars > 500 AS INT)) FILTER (toxic = 1) AS z FROM b) SELECT 'has_body' AS flag, round(a, 6) AS rate_0, round(z, 6) AS rate_1, round(abs(a - z), 6) AS gap FROM r")
def coverage_gap(spark, d):
    rows = judged(spark, d).withColumn("has_body", text.flag(F.col("n_chars") > 500))
    return rounded(aggregates.coverage_gap(rows, "toxic", ["has_body"]), "rate_0", "rate_1", "gap")


@register(
    "vocabulary_transfer",
    "WITH t AS (SELECT doc_id, doc_id % 2 AS side, unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM documents), k AS (SELECT DISTINCT w FROM t WHERE side = 0), "
    "r AS (SELECT t.doc_id, t.w, CASE WHEN k.w IS NULL THEN 0 ELSE 1 END AS hit FROM t LEFT JOIN k ON t.w = k.w WHERE side = 1) SELECT "
    "(SELECT round(avg(h), 6) FROM (SELECT max(hit) AS h FROM r GROUP BY w)) AS vocabulary_coverage, (SELECT round(avg(hit), 6) FROM r) AS token_coverage, "
    "(SELECT count(*) FROM (SELECT sum(hit) AS s FROM r GROUP BY doc_id) WHERE s = 0) AS zero_rows, (SELECT round(avg(s), 6) FROM (SELECT sum(hit) AS s FROM r GROUP BY doc_id)) AS active_per_row",
)
def vocabulary_transfer(spark, d):
    words = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2).alias("side"), F.explode(words).alias("w"))
    return rounded(aggregates.vocabulary_transfer(rows, "side", "doc_id", "w"), "vocabulary_coverage", "token_coverage", "active_per_row")


@register("integrity", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, sum(CAST(quality IS NULL AS INT) + CAST(toxic IS NULL AS INT)) AS n_nulls, bool_and(quality IN (0, 1)) AS labels_binary FROM labels")
def integrity(spark, d):
    return aggregates.integrity(table(spark, d, "labels"), "doc_id", ["quality", "toxic"], "quality")


@register(
    "quantile_bin_errors",
    f"WITH {JUDGED}, e AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS m, quantile_cont(n_chars, 0.75) AS z FROM b) "
    "SELECT CASE WHEN n_chars <= a THEN 1 WHEN n_chars <= m THEN 2 WHEN n_chars <= z THEN 3 ELSE 4 END AS bin, count(*) AS n, count(*) FILTER (quality = 1 AND pred = 0) AS fn, count(*) FILTER (quality = 0 AND pred = 1) AS fp, round(avg(pred), 6) AS positive_rate FROM b, e GROUP BY 1",
)
def quantile_bin_errors(spark, d):
    return rounded(aggregates.error_rates(aggregates.quantile_bins(judged(spark, d), "n_chars"), ["bin"], "quality", "pred"), "positive_rate")


@register("agreement", f"WITH {JUDGED} SELECT round(avg(CAST(quality = pred AS INT)), 6) AS agree, round(avg(CAST(quality <> pred AS INT)), 6) AS disagree, round(avg(abs(score - quality)), 6) AS mean_gap FROM b")
def agreement(spark, d):
    return rounded(aggregates.agreement(judged(spark, d), "quality", "pred", "score", "quality"), "agree", "disagree", "mean_gap")


@register("fold_composition", f"WITH {JUDGED}, f AS (SELECT *, doc_id % 5 AS fold FROM b), g AS (SELECT n_chars, min(fold) AS lo, max(fold) AS hi FROM f GROUP BY n_chars) SELECT fold, count(*) AS n, round(avg(quality), 6) AS rate, round(avg(CAST(lo < hi AS INT)), 6) AS seen_group_share FROM f JOIN g USING (n_chars) GROUP BY fold")
def fold_composition(spark, d):
    rows = judged(spark, d).withColumn("fold", F.col("doc_id") % 5)
    return rounded(aggregates.fold_composition(rows, "fold", "quality", "n_chars"), "rate", "seen_group_share")


@register("feature_checks", f"WITH {JUDGED} SELECT 'quality' AS feature, count(DISTINCT quality) AS n_distinct, count(DISTINCT quality) <= 1 AS constant FROM b UNION ALL SELECT 'lang', count(DISTINCT lang), count(DISTINCT lang) <= 1 FROM b")
def feature_checks(spark, d):
    return aggregates.feature_checks(judged(spark, d), ["quality", "lang"])


@register("correlations", f"WITH {JUDGED} SELECT 'n_chars' AS a, 'quality' AS b, round(corr(n_chars, quality), 6) AS r FROM b UNION ALL SELECT 'n_chars', 'toxic', round(corr(n_chars, toxic), 6) FROM b UNION ALL SELECT 'quality', 'toxic', round(corr(quality, toxic), 6) FROM b")
def correlations(spark, d):
    return rounded(aggregates.correlations(judged(spark, d), ["n_chars", "quality", "toxic"]), "r")


@register("group_mean", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS customer_mean FROM orders")
def group_mean(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("v"))
    return aggregates.group_mean(rows, "o_custkey", "v", "customer_mean").select("o_orderkey", F.round("customer_mean", 4).alias("customer_mean"))


@register("recurrence", "SELECT doc_id, count(*) OVER (PARTITION BY text) AS times FROM documents")
def recurrence(spark, d):
    return aggregates.recurrence(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "h").select("doc_id", "times")


# --- relational ----------------------------------------------------------------------------------


@register("outcomes", f"WITH {JUDGED} SELECT CASE WHEN quality = 1 AND pred = 1 THEN 'TP' WHEN quality = 0 AND pred = 0 THEN 'TN' WHEN pred = 1 THEN 'FP' ELSE 'FN' END AS outcome, count(*) AS n FROM b GROUP BY 1")
def outcomes(spark, d):
    return judged(spark, d).groupBy(relational.outcome(F.col("quality"), F.col("pred")).alias("outcome")).agg(F.count("*").alias("n"))


@register("buckets", "SELECT CAST(least(n_chars // 100, 15) AS INT) AS bucket, count(*) AS n, round(avg(greatest(0, least(n_chars, 1000))), 6) AS clipped FROM documents GROUP BY 1")
def buckets(spark, d):
    rows = table(spark, d, "documents").groupBy(relational.bucket(F.col("n_chars"), 100, 15).alias("bucket"))
    return rounded(rows.agg(F.count("*").alias("n"), F.avg(relational.clip(F.col("n_chars"), 0, 1000)).alias("clipped")), "clipped")


@register("factorised_pairs", "SELECT doc_id, lang || '||' || source AS pair, dense_rank() OVER (ORDER BY lang || '||' || source) - 1 AS code FROM documents")
def factorised_pairs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", relational.pair_key(F.col("lang"), F.col("source")).alias("pair"))
    return relational.factorise(rows, "pair").select("doc_id", "pair", "code")


@register("left_lookup", "SELECT d.doc_id, l.quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_lookup(spark, d):
    rows = relational.left_lookup(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return relational.lookup_default(rows, table(spark, d, "labels"), "doc_id", "toxic", -1)


@register("member_rule", f"WITH {JUDGED}, m AS (SELECT DISTINCT n_chars FROM documents WHERE doc_id % 10 = 0) SELECT doc_id, CASE WHEN n_chars IN (SELECT n_chars FROM m) THEN 1 ELSE pred END AS pred FROM b")
def member_rule(spark, d):
    members = table(spark, d, "documents").filter("doc_id % 10 = 0").select("n_chars")
    return relational.member_rule(judged(spark, d), members, "n_chars", "pred").select("doc_id", "pred")


@register("rule_audit", f"WITH {JUDGED}, m AS (SELECT DISTINCT n_chars FROM documents WHERE doc_id % 10 = 0), h AS (SELECT * FROM b WHERE n_chars IN (SELECT n_chars FROM m)) SELECT count(*) AS covered, round(sum(quality) / count(*), 6) AS precision, sum(quality) = count(*) AS enabled FROM h")
def rule_audit(spark, d):
    members = table(spark, d, "documents").filter("doc_id % 10 = 0").select("n_chars")
    return rounded(relational.audit_rule(judged(spark, d), members, "n_chars", "quality"), "precision")


@register("unseen_keys", "SELECT DISTINCT n_chars FROM documents WHERE doc_id % 2 = 1 AND n_chars NOT IN (SELECT n_chars FROM documents WHERE doc_id % 2 = 0)")
def unseen_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return relational.unseen(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"), "n_chars")


@register("flips", "SELECT doc_id, quality AS before, toxic AS after FROM labels WHERE quality <> toxic")
def flips(spark, d):
    l = table(spark, d, "labels")
    return relational.flips(l.select("doc_id", F.col("quality").alias("y")), l.select("doc_id", F.col("toxic").alias("y")), "doc_id", "y")


@register("overlap_counts", "SELECT (SELECT count(*) FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)) AS shared_text, (SELECT count(*) FROM (SELECT n_chars FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT n_chars FROM documents WHERE doc_id % 2 = 1)) AS shared_n_chars")
def overlap_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    return relational.overlap_counts(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "text", "n_chars")


@register("nearest_edit", "WITH p AS (SELECT DISTINCT p_name AS n FROM part), q AS (SELECT DISTINCT n FROM (SELECT 'x' || p_name AS n FROM part WHERE p_partkey % 20 = 0)) SELECT q.n AS name, least(min(levenshtein(q.n, p.n)), 4) AS distance FROM q, p GROUP BY q.n")
def nearest_edit(spark, d):
    parts = table(spark, d, "part")
    asked = parts.filter("p_partkey % 20 = 0").select(F.concat(F.lit("x"), "p_name").alias("name"))
    return relational.nearest_edit(asked, parts, "name", "p_name", 3)


@register("first_max", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def first_max(spark, d):
    return relational.first_max(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", -F.col("doc_id"))


@register("top_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def top_rows(spark, d):
    return relational.top(table(spark, d, "documents").select("doc_id", "n_chars"), 20, F.desc("n_chars"), "doc_id")


@register("tag_union", "SELECT tag, count(*) AS n FROM (SELECT doc_id AS id, 'docs' AS tag FROM documents UNION ALL SELECT item_id, 'items' FROM benchmark) GROUP BY tag")
def tag_union(spark, d):
    got = relational.tag_union(docs=table(spark, d, "documents").select(F.col("doc_id").alias("id")), items=table(spark, d, "benchmark").select(F.col("item_id").alias("id")))
    return got.groupBy("tag").agg(F.count("*").alias("n"))


@register(
    "shared_tokens",
    "WITH l AS (SELECT l_orderkey, list_distinct([l_returnflag, l_linestatus, CAST(year(l_shipdate) AS VARCHAR)]) AS ts FROM lineitem), t AS (SELECT l_orderkey, unnest(ts) AS token FROM l), n AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY l_orderkey) "
    "SELECT l_orderkey, token FROM t JOIN n USING (l_orderkey) GROUP BY l_orderkey, token, n HAVING count(*) = n",
)
def shared_tokens(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.array("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("string")).alias("t"))
    return relational.shared_tokens(rows, "l_orderkey", "t")


# --- text and vectors ----------------------------------------------------------------------------


@register("text_shapes", "SELECT doc_id, length(text) AS n, length(text) - length(replace(text, ',', '')) AS commas, length(text) - length(replace(text, '\"', '')) AS quotes, CASE WHEN regexp_matches(text, '[A-Za-z]{2,}') THEN 1 ELSE 0 END AS latin, sha256(text) AS digest FROM documents")
def text_shapes(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(c).alias("n"), text.count_of(c, ",").alias("commas"), text.count_of(c, '"').alias("quotes"), text.flag(c.rlike(titles.LATIN_RUN)).alias("latin"), F.sha2(c, 256).alias("digest"))


@register("logistic", "SELECT doc_id, round(1 / (1 + exp(-(n_chars % 7 - 3))), 6) AS p FROM documents")
def logistic(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.logistic((F.col("n_chars") % 7 - 3).cast("double")), 6).alias("p"))


@register("json_props", "SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").select(F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@register("jaccard_titles", "WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS z FROM part) SELECT p_partkey, round(len(list_intersect(a, z)) / len(list_distinct(list_concat(a, z))), 6) AS j FROM p")
def jaccard_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(text.jaccard(F.split("p_name", " "), F.split(F.lower("p_type"), " ")), 6).alias("j"))


TF = "t AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS term FROM part), c AS (SELECT id, term, count(*) AS tf FROM t WHERE length(term) > 1 GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2), w AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS w FROM c JOIN f USING (term))"


@register("tfidf_weights", f"WITH {TF} SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w")
def tfidf_weights(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), vectorize.word_ngrams(F.split("p_name", " ")).alias("t"))
    return rounded(vectorize.TfIdf.fit(docs, "id", "t", 2, sublinear=True).weights(docs, "id", "t"), "weight")


@register("char_ngrams", "WITH w AS (SELECT p_partkey AS id, ' ' || unnest(string_split(lower(p_name), ' ')) || ' ' AS w FROM part), g AS (SELECT id, unnest(list_transform(range(1, greatest(length(w) - 2, 1) + 1), lambda i: substring(w, i, 3))) AS term FROM w) SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM g GROUP BY term")
def char_ngrams(spark, d):
    key, grams = F.col("p_partkey"), vectorize.char_wb_ngrams(F.col("p_name"), 3, 3)
    rows = table(spark, d, "part").select(key, "p_name").withColumn("rows", F.when(key.isNull(), 1).otherwise(F.count("*").over(Window.partitionBy(key))))
    # A key of one row counts its n-grams in that row, so no task holds pairs of key and term; pairs are left for repeated keys alone.
    marks = lambda g: F.concat(F.transform(g, lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("df"))), F.transform(F.array_distinct(g), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), key.isNotNull().cast("int").alias("df"))))
    once = rows.filter("rows = 1").select(F.inline(text.let(grams, marks))).groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    more = rows.filter("rows > 1").select(key, F.explode(grams).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("df"))
    return once.unionByName(more).groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


@register("scaled_numbers", "SELECT p_partkey, round((p_retailprice - m) / s, 4) AS price FROM part, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part)")
def scaled_numbers(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    return vectorize.Scaler.fit(rows, ["price"]).transform(rows).withColumn("price", F.round("price", 4))


@register("one_hot", "SELECT doc_id, 'lang=' || lang AS term, 1.0::DOUBLE AS weight FROM documents WHERE lang IS NOT NULL")
def one_hot(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return vectorize.one_hot(docs, "doc_id", "lang", docs)


# --- validation ----------------------------------------------------------------------------------


@register("stratified_fold_sizes", f"WITH {JUDGED}, n AS (SELECT quality, count(*) AS c FROM b GROUP BY quality) SELECT quality, f AS fold, c // 5 + CASE WHEN f < c % 5 THEN 1 ELSE 0 END AS n FROM n, (SELECT CAST(unnest(range(5)) AS INT) AS f)")
def stratified_fold_sizes(spark, d):
    return validation.stratified_folds(judged(spark, d), "doc_id", "quality").groupBy("quality", "fold").agg(F.count("*").alias("n"))


@register(
    "group_folds",
    "WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY source), "
    "a AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS source, CAST(0 AS BIGINT) AS n, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(0 AS BIGINT) AS p "
    "UNION ALL SELECT g.r, g.source, g.n, list_transform(a.loads, lambda x, i: x + CASE WHEN i = list_position(a.loads, list_min(a.loads)) THEN g.n ELSE 0 END), CAST(list_position(a.loads, list_min(a.loads)) AS BIGINT) FROM a JOIN g ON g.r = a.r + 1) "
    "SELECT source, n, CAST(p - 1 AS INT) AS fold FROM a WHERE r > 0",
)
def group_folds(spark, d):
    return validation.group_folds(table(spark, d, "documents").select("source"), "source").groupBy("source", "fold").agg(F.count("*").alias("n"))


@register(
    "cross_fitted_thresholds",
    f"WITH {JUDGED}, g AS (SELECT unnest(range(5, 96)) / 100 AS t), x AS (SELECT doc_id % 5 AS fold, t, {CLASS_COUNTS.replace('pred = 1', 'score >= t').replace('pred = 0', 'score < t')} FROM b, g GROUP BY 1, 2), "
    "o AS (SELECT f.fold, x.t, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold GROUP BY 1, 2), "
    f"p AS (SELECT fold, t, row_number() OVER (PARTITION BY fold ORDER BY round({scaled(fb(2))}, 12) DESC, round(abs(t - 0.5), 12), t) AS r FROM o) "
    f"SELECT x.fold, round(x.t, 2) AS threshold, round({scaled(fb(2))}, 6) AS m2 FROM x JOIN p ON x.fold = p.fold AND x.t = p.t WHERE r = 1",
)
def cross_fitted_thresholds(spark, d):
    rows = judged(spark, d).withColumn("fold", F.col("doc_id") % 5)
    return rounded(validation.cross_fitted_thresholds(rows, "quality", "score"), "m2").withColumn("threshold", F.round("threshold", 2))


@register("fold_deltas", f"WITH {JUDGED}, a AS (SELECT doc_id % 5 AS fold, {CLASS_COUNTS} FROM b GROUP BY 1), z AS (SELECT doc_id % 5 AS fold, {CLASS_COUNTS.replace('pred', 'toxic')} FROM b GROUP BY 1), s AS (SELECT fold, n, {fb(2)} AS v FROM a), u AS (SELECT fold, {fb(2)} AS v FROM z) SELECT fold, n, round((s.v - u.v) / 0.45, 6) AS delta FROM s JOIN u USING (fold)")
def fold_deltas(spark, d):
    rows = judged(spark, d).withColumn("fold", F.col("doc_id") % 5)
    a, b = (validation.fold_scores(rows, "quality", p, ["fold"]) for p in ("pred", "toxic"))
    return rounded(validation.paired_deltas(a, b, ["fold"]), "delta")


OFFSETS = "g AS (SELECT source, count(*) AS n, avg(score) AS m FROM b GROUP BY source), o AS (SELECT source, (m - (SELECT avg(score) FROM b)) * n / (n + 5) AS offset_ FROM g)"


@register("group_offsets", f"WITH {JUDGED}, {OFFSETS} SELECT source, round(offset_, 6) AS offset FROM o")
def group_offsets(spark, d):
    return rounded(validation.group_offsets(judged(spark, d), "source", "score"), "offset")


@register("centred_scores", f"WITH {JUDGED}, {OFFSETS} SELECT doc_id, round(greatest(0, least(1, score - least(offset_, 0))), 6) AS centred FROM b JOIN o USING (source)")
def centred_scores(spark, d):
    rows = judged(spark, d)
    return rounded(validation.apply_centering(rows, validation.group_offsets(rows, "source", "score", one_sided=True), "source", "score"), "centred").select("doc_id", "centred")


@register("miss_categories", f"WITH {JUDGED} SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN lang <> 'en' THEN 'foreign' ELSE 'other' END AS category, count(*) AS n FROM b WHERE quality = 1 AND pred = 0 GROUP BY 1")
def miss_categories(spark, d):
    c = validation.miss_category(F.col("quality"), F.col("pred"), [("short", F.col("n_chars") < 500), ("foreign", F.col("lang") != "en")])
    return judged(spark, d).select(c.alias("category")).filter("category is not null").groupBy("category").agg(F.count("*").alias("n"))


@register("recurrence_encoding", f"WITH {JUDGED}, t AS (SELECT * FROM b WHERE doc_id % 5 <> 0), s AS (SELECT source, count(*) AS n, sum(quality) AS q FROM t GROUP BY source) SELECT doc_id, coalesce(n, 0) AS source_count, CASE WHEN n > 0 THEN 1 ELSE 0 END AS source_seen, round((coalesce(q, 0) + 10 * (SELECT avg(quality) FROM t)) / (coalesce(n, 0) + 10), 6) AS source_rate FROM b LEFT JOIN s USING (source) WHERE doc_id % 5 = 0")
def recurrence_encoding(spark, d):
    rows = judged(spark, d)
    got = validation.recurrence_encoding(rows.filter("doc_id % 5 <> 0"), rows.filter("doc_id % 5 = 0"), "source", "quality")
    return rounded(got, "source_rate").select("doc_id", "source_count", "source_seen", "source_rate")


@register("majority_vote", "SELECT conv_id, count(*) AS n, round(avg(CAST(length(text) > 100 AS INT)), 6) AS share, CASE WHEN avg(CAST(length(text) > 100 AS INT)) > 0.5 THEN 1 ELSE 0 END AS pred FROM conversations GROUP BY conv_id")
def majority_vote(spark, d):
    votes = table(spark, d, "conversations").select("conv_id", text.flag(F.length("text") > 100).alias("v"))
    return rounded(validation.majority_vote(votes, "conv_id", "v"), "share")


@register("base_rate_blend", f"WITH {JUDGED}, r AS (SELECT n_chars, avg(quality) AS rate FROM b WHERE doc_id % 2 = 0 GROUP BY n_chars) SELECT doc_id, CASE WHEN rate < 0.15 THEN 0 WHEN rate > 0.85 THEN 1 ELSE pred END AS pred FROM b LEFT JOIN r USING (n_chars)")
def base_rate_blend(spark, d):
    rows = judged(spark, d)
    return validation.base_rate_blend(rows, aggregates.group_rates(rows.filter("doc_id % 2 = 0"), "n_chars", "quality"), "n_chars", "pred").select("doc_id", "pred")


# --- records and titles by formula ---------------------------------------------------------------


def formula_records(spark: SparkSession, d: str) -> DataFrame:
    """Titles and records written from customer keys."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    code = F.concat(F.chr(65 + k % 26), F.lpad(s(k % 100), 2, "0"), F.lit("."), s(k % 10))
    head = F.concat(F.lit("Код МКБ-10: "), code, F.lit("\nПол: "), F.when(k % 2 == 0, "Женский").otherwise("Мужской"), F.lit("\nВозраст: "), s(k % 100), F.lit(" лет\n"))
    level = F.when(k % 3 == 0, "тяжёлый").when(k % 3 == 1, "лёгкий").otherwise("обычный")
    body = F.concat(F.lit("Жалобы: боль номер "), s(k), F.when(k % 7 == 0, F.lit(", тошноты не выявлено")).otherwise(""), F.lit("\nПоказатель: Hb, Результат: "), s(k % 200), F.lit("\nОбъективный статус: процесс "), level)
    record = F.concat(F.when(k % 5 == 0, F.concat(F.lit("Пациент, "), s(k % 90), F.lit(" лет\n"))).otherwise(head), body)
    topic = F.when(k % 4 == 0, "беременных").when(k % 4 == 1, "предстательной простаты").when(k % 4 == 2, F.concat(F.lit("детей до "), s(k % 50), F.lit(" лет"))).otherwise("процесс")
    title = F.concat(F.lit('Рекомендации "Болезнь '), s(k % 30), F.lit('"\nВозраст: Взрослые\n# Лечение\n## Раздел\n'), F.repeat(F.lit("#"), (k % 3 + 1).cast("int")), F.lit(" тяжёлый случай у "), topic)
    return dealt(table(spark, d, "customer").select(k)).select(k.alias("id"), title.alias("title_text"), record.alias("protocol_text"))


def from_titles(spark: SparkSession, d: str, made: dict[str, Column]) -> DataFrame:
    """(id, ...) of columns made of ``title_text`` alone: titles repeat, so each distinct one is taken apart once and joined back by digest.

    What is made is written first, so that Spark knows whether it is little enough to be sent to all tasks.
    """
    rows = formula_records(spark, d)
    found = rows.select("title_text").distinct().select(F.md5("title_text").alias("_text"), *(c.alias(k) for k, c in made.items()))
    own = rows.select("id", F.md5("title_text").alias("_digest"))
    return own.join(written(found, "titles"), F.col("_digest").eqNullSafe(F.col("_text"))).select("id", *made)


@register(
    "record_fields",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 90 ELSE c_custkey % 100 END AS DOUBLE) AS age, "
    "CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS header, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS negations, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'NA' ELSE chr(CAST(65 + c_custkey % 26 AS INT)) || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '.' || (c_custkey % 10) END AS icd, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'NA' ELSE chr(CAST(65 + c_custkey % 26 AS INT)) || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') END AS icd_cat, "
    "'боль номер ' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN ', тошноты не выявлено' ELSE '' END || ' процесс ' || CASE c_custkey % 3 WHEN 0 THEN 'тяжёлый' WHEN 1 THEN 'лёгкий' ELSE 'обычный' END AS narrative, "
    "length('Показатель: Hb, Результат: ' || (c_custkey % 200)) AS lab FROM customer",
)
def record_fields(spark, d):
    c = F.col("protocol_text")
    f = records.record_fields(c)
    code = records.icd_code(c)
    lab = F.round(records.lab_share(c) * F.length(c)).cast("long")
    return formula_records(spark, d).select("id", f["gender_raw"].alias("gender"), f["age"].alias("age"), f["has_structured_header"].alias("header"), f["negation_count"].alias("negations"), code.alias("icd"), records.icd_category(code).alias("icd_cat"), f["narrative_text"].alias("narrative"), lab.alias("lab"))


@register("clean_records", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS has_icd, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS has_sex, 1 AS has_complaints, 0 AS has_date, true AS without_lab FROM customer")
def clean_records(spark, d):
    c = F.col("protocol_text")
    p = records.presence(c)
    return formula_records(spark, d).select("id", *(p[k].alias(k) for k in ("has_icd", "has_sex", "has_complaints", "has_date")), (~records.clean_record(c).contains("Показатель")).alias("without_lab"))


@register(
    "title_parts",
    "SELECT c_custkey AS id, 'Рекомендации \"Болезнь ' || (c_custkey % 30) || '\"' AS guideline, 'Возраст: Взрослые' AS age_category, c_custkey % 3 + 1 AS depth, 5 AS n_lines, 2 AS n_quotes, 2 AS n_words_guideline_less_one, CASE WHEN c_custkey % 4 = 2 THEN 1 ELSE 0 END AS has_digit FROM customer",
)
def title_parts(spark, d):
    t = F.col("title_text")
    p, f = titles.parse_title(t), titles.struct_features(t)
    return from_titles(spark, d, {**{k: p[k] for k in ("guideline", "age_category")}, **{k: f[k] for k in ("depth", "n_lines", "n_quotes")}, "n_words_guideline_less_one": f["n_words_guideline"] - 1, "has_digit": f["has_digit"]})


@register("masked_shapes", "SELECT c_custkey AS id, c_custkey % 3 + 1 AS depth, 2 AS n_quotes_guideline, 0 AS cyrillic_left, 'D' || (c_custkey % 3 + 1) AS first_token FROM customer")
def masked_shapes(spark, d):
    t = F.col("title_text")
    s = titles.skeleton_features(t)
    masked = text.mask_cyrillic(t)
    return from_titles(spark, d, {"depth": s["depth"], "n_quotes_guideline": text.count_of(titles.parse_title(masked)["guideline"], '"'), "cyrillic_left": text.flag(masked.rlike(text.CYRILLIC)), "first_token": F.get(F.split(titles.invariant_tokens(t), " "), F.lit(0))})


@register(
    "contradictions",
    "WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 90 ELSE c_custkey % 100 END AS age, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS g, "
    "CASE c_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS need, CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 END AS lvl FROM customer) SELECT k AS id, "
    "CASE WHEN k % 4 = 2 AND age > k % 50 THEN 1 ELSE 0 END AS age_contradiction, CASE WHEN need IS NOT NULL THEN 1 ELSE 0 END AS gender_condition_present, CASE WHEN need IS NOT NULL AND (g IS NULL OR k % 4 = 0) THEN 1 ELSE 0 END AS gender_unknown, "
    "CASE WHEN lvl = 3 THEN 1 ELSE 0 END AS severity_match, CASE WHEN lvl <> 3 THEN 1 ELSE 0 END AS severity_contradiction, CASE WHEN lvl IS NULL THEN 1 ELSE 0 END AS severity_unknown FROM c",
)
def contradictions(spark, d):
    got = conditions.applicability_frame(formula_records(spark, d))
    return got.select("id", "age_contradiction", "gender_condition_present", "gender_unknown", "severity_match", "severity_contradiction", "severity_unknown")


@register("decoded_lines", "SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' ELSE '4+' END AS candidates, count(*) AS n FROM (SELECT m, count(DISTINCT l) AS n FROM (SELECT regexp_replace(l, '[a-z]', '?', 'g') AS m, l FROM (SELECT p_name AS l FROM part)) GROUP BY m) GROUP BY 1")
def decoded_lines(spark, d):
    lines = table(spark, d, "part").select("p_partkey", "p_name")
    index = lines.select(F.regexp_replace("p_name", "[a-z]", "?").alias("masked"), F.col("p_name").alias("clean")).distinct().withColumn("source", F.lit(None).cast("bigint"))
    asked = index.select("masked").distinct().withColumn("id", F.xxhash64("masked"))
    return decode.decode_audit(decode.decode_lines(asked, index, "id", "masked"))


@register("applicability_oof")
def applicability_oof(spark, d):
    from sectiva.plans import applicability

    rows = applicability.stage2_inputs(formula_records(spark, d)).withColumn("label", ((F.col("severity_match") == 1) & (F.col("age_contradiction") == 0)).cast("int"))
    return applicability.evaluate(rows, applicability.stage2_spec(), k=3)


@register("general_titles_oof")
def general_titles_oof(spark, d):
    from sectiva.plans import applicability

    rows = formula_records(spark, d).withColumn("label", F.col("title_text").contains("простаты").cast("int"))
    return applicability.evaluate_texts(rows, "title_text", lambda x: x.withColumns(applicability.stage1_inputs(F.col("title_text"))), applicability.stage1_spec(), k=3)


from sectiva.plans import fits, reports, texts  # noqa: E402, F401

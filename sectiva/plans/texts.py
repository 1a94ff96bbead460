"""Registered queries of text functions, folds and files over whole tables, with their SQL equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sectiva.functions import conditions, records, text, titles
from sectiva.operators import aggregates, decode, metrics, models, relational, validation, vectorize
from sectiva.plans.catalog import CLASS_COUNTS, JUDGED, dealt, fb, formula_records, from_titles, judged, register, rounded, scaled, table
from sectiva.sources import files
from sectiva.sources.stages import shared_dir

LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
SPLIT = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
#: The title that ``formula_records`` writes, as SQL.
TITLES = """t AS (SELECT c_custkey AS id, 'Рекомендации "Болезнь ' || (c_custkey % 30) || '"' AS guide, repeat('#', CAST(c_custkey % 3 + 1 AS INT)) AS marks,
  'тяжёлый случай у ' || CASE c_custkey % 4 WHEN 0 THEN 'беременных' WHEN 1 THEN 'предстательной простаты' WHEN 2 THEN 'детей до ' || (c_custkey % 50) || ' лет' ELSE 'процесс' END AS body FROM customer),
w AS (SELECT *, guide || chr(10) || 'Возраст: Взрослые' || chr(10) || '# Лечение' || chr(10) || '## Раздел' || chr(10) || marks || ' ' || body AS title, string_split(body, ' ') AS words FROM t)"""


def documents(spark, d):
    return table(spark, d, "documents")


def whole_texts(spark, d):
    """Documents whose texts are read whole, dealt over tasks."""
    return dealt(documents(spark, d).select("doc_id", "text"), "doc_id", "text")


# --- plain texts ---------------------------------------------------------------------------------


@register("normalised_texts", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents")
def normalised_texts(spark, d):
    return whole_texts(spark, d).select("doc_id", F.md5(text.normalise(F.col("text"))).alias("digest"))


@register(
    "word_digests",
    "SELECT doc_id, len(regexp_extract_all(lower(text), '[а-яёa-z]+')) AS n_all, "
    f"md5(array_to_string(list_filter(regexp_extract_all(lower(text), '[а-яёa-z]+'), lambda x: NOT list_contains({LIST(text.STOPWORDS)}, x)), ' ')) AS record_words, "
    "md5(array_to_string(regexp_extract_all(lower(text), '\\pL+'), ' ')) AS title_words, "
    f"md5(array_to_string({SPLIT.format(chr(39).join(('lower(replace(text, ', '#', ', ', ' ', '))')))}, ' ')) AS tokens FROM documents",
)
def word_digests(spark, d):
    c = F.col("text")
    joined = lambda x: F.md5(F.array_join(x, " "))
    return whole_texts(spark, d).select(
        "doc_id", F.size(text.record_words(c, ())).cast("long").alias("n_all"), joined(text.record_words(c)).alias("record_words"), joined(text.title_words(c)).alias("title_words"), joined(text.hash_tokens(c)).alias("tokens")
    )


@register(
    "text_metadata",
    f"SELECT doc_id, length(text) AS len_chars, length(text) - length(replace(text, chr(10), '')) AS n_newlines, CAST(regexp_matches(text, '[A-Za-z]{{2,}}') AS INT) AS has_latin, CAST(regexp_matches(text, '[0-9]') AS INT) AS has_digit, "
    f"length(text) - length(replace(text, '\"', '')) AS n_quotes, coalesce(list_max(list_transform({SPLIT.format('text')}, lambda x: length(x))), 0) AS max_word_len, "
    "round((length(text) - length(replace(text, '?', ''))) / nullif(length(text), 0), 6) AS question_share, CAST(right(rtrim(text, ' ' || chr(9) || chr(10) || chr(13)), 1) IN ('.', '!', '?', ';', ':') AS INT) AS ends_in_punctuation, "
    "CAST(length(text) IN (256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 255, 511, 1023, 2047, 4095, 8191, 16383, 32767, 65535) AS INT) AS power_of_two FROM documents",
)
def text_metadata(spark, d):
    c = F.col("text")
    damage = records.integrity_flags(c)
    got = whole_texts(spark, d).select("doc_id", *(x.alias(k) for k, x in titles.meta_features(c).items()), records.question_share(c).alias("question_share"), *(damage[k].alias(k) for k in ("ends_in_punctuation", "power_of_two")))
    return rounded(got, "question_share")


@register("last_lines", "SELECT doc_id, md5(list_extract(s, -1)) AS last, length(regexp_extract(list_extract(s, -1), '^#*')) AS depth, md5(list_extract(s, 1)) AS first FROM (SELECT doc_id, string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AS s FROM documents)")
def last_lines(spark, d):
    c = F.col("text")
    return documents(spark, d).select("doc_id", F.md5(text.last_line(c)).alias("last"), text.heading_depth(c).cast("long").alias("depth"), F.md5(titles.guideline_name(c)).alias("first"))


@register("prompts", "SELECT doc_id, md5('Источник: ' || source || chr(10) || 'Текст: ' || left(text, 7000)) AS prompt, md5(right(text, 400)) AS tail FROM documents")
def prompts(spark, d):
    return documents(spark, d).select("doc_id", F.md5(records.prompt(F.col("source"), F.col("text"), "Источник: %s\nТекст: %s")).alias("prompt"), F.md5(F.right("text", F.lit(400))).alias("tail"))


@register(
    "token_recall",
    f"WITH w AS (SELECT item_id, {SPLIT.format('lower(text)')} AS w FROM benchmark), s AS (SELECT item_id, list_distinct(w) AS own, list_sort(list_intersect(list_distinct(w), (SELECT list_distinct(w) FROM w ORDER BY item_id LIMIT 1))) AS shared FROM w) "
    "SELECT item_id, round(len(shared) / nullif(len(own), 0), 6) AS recall, CAST(len(shared) > 5 AS INT) AS over, array_to_string(shared[:5], ' ') AS five FROM s",
)
def token_recall(spark, d):
    words = table(spark, d, "benchmark").select("item_id", text.split_words(F.lower("text")).alias("w"))
    first = words.agg(F.min_by("w", "item_id").alias("first"))
    a, b = F.col("w"), F.col("first")
    got = words.crossJoin(F.broadcast(first)).select("item_id", text.token_recall(a, b).alias("recall"), conditions.shared_over_limit(a, b).alias("over"), F.array_join(text.sorted_prefix(a, b), " ").alias("five"))
    return rounded(got, "recall")


@register(
    "word_bigrams",
    "SELECT doc_id, len(u) + greatest(len(u) - 1, 0) AS n, md5(array_to_string(list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])), '|')) AS terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS u FROM documents)",
)
def word_bigrams(spark, d):
    rows = whole_texts(spark, d).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("u"))
    grams = vectorize.word_ngrams(F.col("u"), 1, 2)
    return rows.select("doc_id", F.size(grams).cast("long").alias("n"), F.md5(F.array_join(grams, "|")).alias("terms"))


@register("span_places", "SELECT c_custkey AS id, 2 * (c_custkey % 40) AS first_start, 2 * (c_custkey % 40) + 8 AS first_end, 2 * (c_custkey % 40) + 10 + 5 * (c_custkey % 7) AS last_start, 2 * (c_custkey % 40) + 23 + 5 * (c_custkey % 7) AS last_end, 2 AS n, c_custkey % 7 <= 3 AS near, list_transform(range(0, c_custkey % 9), lambda i: CAST(i AS INT))::VARCHAR AS places FROM customer")
def span_places(spark, d):
    k = F.col("c_custkey")
    line = F.concat(F.repeat(F.lit("а "), (k % 40).cast("int")), F.lit("нет боли, "), F.repeat(F.lit("слой "), (k % 7).cast("int")), F.lit("не обнаружено метка"))
    rows = dealt(table(spark, d, "customer").select(k)).select(k.alias("id"), line.alias("line"), F.repeat(F.lit("о"), (k % 9 + 1).cast("int")).alias("row"))
    s = text.negation_spans(F.col("line"))
    first, last = F.get(s, F.lit(0)), F.element_at(s, -1)
    near = text.near_spans(F.col("line"), F.slice(s, 1, 1), F.lit("метка"), 40)
    return rows.select(
        "id", first["s"].alias("first_start"), first["e"].alias("first_end"), last["s"].alias("last_start"), last["e"].alias("last_end"), F.size(s).alias("n"), near.alias("near"),
        F.concat(F.lit("["), F.array_join(text.hits(F.col("row"), F.lit("оо")), ", "), F.lit("]")).alias("places"),
    )


# --- titles and records --------------------------------------------------------------------------

_GROUPS = lambda words: " + ".join(f"CAST(list_has_any({words}, {LIST(ws.split())}) AS INT)" for ws in titles.CONDITION_GROUPS.values())
_LETTERS = "regexp_extract_all(lower({0}), '\\pL+')"


@register(
    "title_structure",
    f"WITH {TITLES} SELECT id, length(marks) AS depth, 5 AS n_lines, length(title) AS len_title, length(body) AS len_subsection, len(words) AS n_words_subsection, 3 AS n_words_guideline, 0 AS has_latin, CAST(regexp_matches(body, '[0-9]') AS INT) AS has_digit, "
    "0 AS n_parens, 0 AS n_commas, 2 AS n_quotes, "
    f"{_GROUPS(_LETTERS.format('body'))} AS n_cond_groups_sub, {_GROUPS(_LETTERS.format('title[: length(title) - length(body)]'))} AS n_cond_groups_ctx FROM w",
)
def title_structure(spark, d):
    return from_titles(spark, d, titles.struct_features(F.col("title_text")))


@register(
    "skeletons",
    f"WITH {TITLES}, n AS (SELECT *, list_transform(words, lambda x: length(x)) AS z FROM w) SELECT id, length(marks) AS depth, 5 AS n_lines, length(guide) AS len_guideline, length(marks) + 1 + length(body) AS len_subsection, length(body) AS len_body, len(words) AS n_words_body, "
    "round(list_avg(z), 6) AS mean_word_len, list_max(z) AS max_word_len, list_min(z) AS min_word_len, 0 AS n_parens, 0 AS n_commas, 0 AS n_dashes, 0 AS n_colons, len(regexp_extract_all(body, '[0-9]')) AS n_digits_body, 0 AS n_quotes, 0 AS has_latin_body, "
    "CAST(regexp_matches(body, '[0-9]') AS INT) AS has_digit_body, 0 AS n_guideline_parens, 0 AS n_guideline_commas, 3 AS n_words_guideline, len(list_filter(z, lambda x: x >= 10)) AS n_long_words, len(list_filter(z, lambda x: x <= 3)) AS n_short_words, "
    "round(len(list_filter(z, lambda x: x >= 10)) / len(z), 6) AS long_word_ratio FROM n",
)
def skeletons(spark, d):
    return rounded(from_titles(spark, d, titles.skeleton_features(F.col("title_text"))), "mean_word_len", "long_word_ratio")


@register(
    "invariant_tokens",
    f"WITH {TITLES} SELECT id, 'D' || length(marks) || ' AGE=???????: ????????' || ' NW' || len(words) || ' LEN' || length(body) // 10 || ' NL5' || CASE WHEN regexp_matches(body, '[0-9]') THEN ' HASDIGIT' ELSE '' END || ' ' || "
    "array_to_string(list_transform(words, lambda x: 'w' || length(x) || CASE WHEN regexp_matches(x, '[0-9]') THEN 'd' ELSE '' END), ' ') AS tokens FROM w",
)
def invariant_tokens(spark, d):
    return from_titles(spark, d, {"tokens": titles.invariant_tokens(F.col("title_text"))})


@register(
    "contradiction_block",
    "WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 90 ELSE c_custkey % 100 END AS age, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS g, "
    "CASE c_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS need, CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 END AS lvl, c_custkey % 3 = 0 OR c_custkey % 4 = 3 AS shared FROM customer), "
    "b AS (SELECT k, need, CASE WHEN k % 4 = 2 AND age > k % 50 THEN 1 ELSE 0 END AS age_contradiction, CASE WHEN need IS NOT NULL THEN 1 ELSE 0 END AS gender_condition_present, CASE WHEN need IS NOT NULL AND (g IS NULL OR k % 4 = 0) THEN 1 ELSE 0 END AS gender_unknown, "
    "CASE WHEN need <> g THEN 1 ELSE 0 END AS gender_contradiction, CASE WHEN lvl = 3 THEN 1 ELSE 0 END AS severity_match, CASE WHEN lvl <> 3 THEN 1 ELSE 0 END AS severity_contradiction, CASE WHEN lvl IS NULL THEN 1 ELSE 0 END AS severity_unknown, "
    "CASE WHEN shared THEN 1 ELSE 0 END AS condition_overlap, CASE WHEN shared AND k % 7 = 0 THEN 1 ELSE 0 END AS condition_contradiction, CASE WHEN shared THEN 0 ELSE 1 END AS condition_unknown FROM c), "
    "n AS (SELECT *, age_contradiction + gender_contradiction + severity_contradiction + condition_contradiction AS contradiction_count, 2 + CAST(k % 4 = 2 AS INT) + CAST(need IS NOT NULL AS INT) AS rules FROM b) "
    "SELECT k AS id, age_contradiction, gender_condition_present, gender_unknown, severity_match, severity_contradiction, severity_unknown, condition_overlap, condition_contradiction, condition_unknown, contradiction_count, round(contradiction_count / rules, 6) AS contradiction_density FROM n",
)
def contradiction_block(spark, d):
    return rounded(conditions.applicability_frame(formula_records(spark, d)).select("id", *conditions.CONTRADICTION), "contradiction_density")


@register(
    "record_presence",
    "SELECT c_custkey AS id, h AS has_icd, h AS has_sex, h AS has_age, 0 AS has_date, 1 AS has_complaints, 0 AS has_anamnesis, 1 AS has_status, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS lex_negation, 0 AS lex_age, 0 AS lex_gender, CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 0 END AS lex_severity, "
    "0 AS mojibake, 'D ' || c_custkey || ' E' AS diagnosis FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS h FROM customer)",
)
def record_presence(spark, d):
    c = F.col("protocol_text")
    said = F.concat(F.lit("Осложнения: E\nДиагноз:  D "), F.col("id").cast("string"), F.lit(" \n"), c)
    return formula_records(spark, d).select("id", *(x.alias(k) for k, x in (records.presence(c) | records.lexicon_flags(c)).items()), records.integrity_flags(c)["mojibake"].alias("mojibake"), records.diagnosis_text(said).alias("diagnosis"))


@register(
    "negation_distances",
    "SELECT k AS id, 2 AS n_condition_tokens, 1 AS condition_present, 1 + e AS condition_present_count, CASE WHEN e = 1 THEN 'отёк|сыпь' ELSE 'сыпь' END AS condition_tokens_matched, 1 + e AS n_condition_tokens_matched, 1 AS negation_count_total, CAST(near AS DOUBLE) AS nearest, "
    "e AS neg_before_condition, CAST(gap <= 50 AS INT) AS neg_after_condition, CAST(near <= 5 AS INT) AS neg_within_5, CAST(near <= 10 AS INT) AS neg_within_10, CAST(near <= 20 AS INT) AS neg_within_20, CAST(near <= 50 AS INT) AS neg_within_50, CAST(near <= 40 AS INT) AS condition_negated_exact "
    "FROM (SELECT *, CASE WHEN e = 1 THEN 1 ELSE gap END AS near FROM (SELECT c_custkey AS k, CAST(c_custkey % 2 AS INT) AS e, c_custkey % 80 + 1 AS gap FROM customer))",
)
def negation_distances(spark, d):
    k = F.col("c_custkey")
    line = F.concat(F.lit("сыпь"), F.repeat(F.lit("_"), (k % 80).cast("int")), F.lit(" нет боли"), F.when(k % 2 == 1, " отёк").otherwise(""))
    rows = dealt(table(spark, d, "customer").select(k)).select(k.alias("id"), line.alias("line"), F.array(F.lit("сыпь"), F.lit("отёк")).alias("terms"))
    return conditions.negation_geometry(rows, "terms", "line").withColumnRenamed("nearest_negation_distance", "nearest").drop("line", "terms")


@register(
    "decoded_titles",
    f"WITH {TITLES}, l AS (SELECT id, p, string_split(title, chr(10))[p] AS clean, regexp_replace(string_split(title, chr(10))[p], '[А-яЁё]', '?', 'g') AS masked FROM w, (SELECT unnest(range(1, 6)) AS p)), "
    "i AS (SELECT masked, clean, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS source FROM l GROUP BY 1, 2), "
    "h AS (SELECT l.id, l.p, count(DISTINCT CASE WHEN i.source IS NULL OR i.source <> l.id THEN i.clean END) AS n FROM l LEFT JOIN i USING (masked) GROUP BY 1, 2) SELECT id, round(avg(CAST(n = 1 AS INT)), 6) AS coverage FROM h GROUP BY id",
)
def decoded_titles(spark, d):
    rows = formula_records(spark, d).select("id", "title_text")
    return rounded(decode.decode_titles(rows, decode.line_index(rows, "id", "title_text"), "id", "title_text").select("id", "coverage"), "coverage")


# --- selections, folds, thresholds ---------------------------------------------------------------


@register("selected_languages", "SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")
def selected_languages(spark, d):
    rows = documents(spark, d).filter(F.col("lang").isin("en", "de"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@register("distinct_sources", "SELECT source, lang FROM documents UNION SELECT source, 'none' FROM documents")
def distinct_sources(spark, d):
    rows = documents(spark, d).select("source", "lang")
    return rows.union(rows.select("source", F.lit("none"))).distinct()


@register("strict_lookup", "SELECT l.doc_id, l.quality, d.lang FROM labels l JOIN documents d USING (doc_id)")
def strict_lookup(spark, d):
    return relational.strict_lookup(table(spark, d, "labels").select("doc_id", "quality"), documents(spark, d).select("doc_id", "lang"), "doc_id")


@register("count_labels", "SELECT doc_id, CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' ELSE '4+' END AS label FROM (SELECT doc_id, n_chars % 6 AS n FROM documents)")
def count_labels(spark, d):
    return documents(spark, d).select("doc_id", relational.count_label(F.col("n_chars") % 6).alias("label"))


_SWEPT = f"s AS (SELECT t, count(*) FILTER (quality = 1 AND score >= t) AS tp, count(*) FILTER (quality = 0 AND score >= t) AS fp, count(*) FILTER (quality = 1 AND score < t) AS fn, count(*) FILTER (quality = 0 AND score < t) AS tn FROM b, (SELECT unnest(range(5, 96)) / 100 AS t) GROUP BY t), m AS (SELECT round(t, 2) AS threshold, {scaled(fb(2))} AS m2 FROM s)"


@register("first_best", f"WITH {JUDGED}, {_SWEPT} SELECT threshold, round(m2, 6) AS m2 FROM m ORDER BY m2 DESC, threshold LIMIT 1")
def first_best(spark, d):
    return rounded(metrics.first_best(metrics.sweep(judged(spark, d), "quality", "score"), "m2"), "m2").withColumn("threshold", F.round("threshold", 2))


@register("plateau", f"WITH {JUDGED}, {_SWEPT} SELECT min(threshold) AS lowest, max(threshold) AS highest, count(*) AS n FROM m WHERE m2 >= (SELECT max(m2) FROM m) - 0.05")
def plateau(spark, d):
    got = metrics.plateau(metrics.sweep(judged(spark, d), "quality", "score"), "m2", 0.05)
    return got.withColumns({k: F.round(k, 2) for k in ("lowest", "highest")})


@register("repeated_fold_sizes", f"WITH {JUDGED}, c AS (SELECT quality, count(*) AS n FROM b GROUP BY quality) SELECT s.seed, quality, f.fold, CAST(n // 5 + CASE WHEN f.fold < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM c, (SELECT unnest(range(0, 3)) AS seed) s, (SELECT unnest(range(0, 5)) AS fold) f")
def repeated_fold_sizes(spark, d):
    return validation.repeated_folds(judged(spark, d), "doc_id", "quality", range(3)).groupBy("seed", "quality", "fold").agg(F.count("*").alias("n"))


@register(
    "out_of_fold_means",
    f"WITH {JUDGED}, f AS (SELECT doc_id, quality, CAST(doc_id % 5 AS INT) AS fold FROM b) SELECT doc_id, fold, round((SELECT avg(quality) FROM f g WHERE g.fold <> f.fold), 6) AS mean FROM f",
)
def out_of_fold_means(spark, d):
    def fit(rows):
        mean = rows.agg(F.avg("quality").alias("mean"))
        return lambda held: held.crossJoin(F.broadcast(mean))

    rows = judged(spark, d).select("doc_id", "quality", (F.col("doc_id") % 5).cast("int").alias("fold"))
    return rounded(validation.out_of_fold(rows, fit).select("doc_id", "fold", "mean"), "mean")


@register("mean_blend", f"WITH {JUDGED} SELECT doc_id, round((score + pred) / 2, 6) AS score FROM b")
def mean_blend(spark, d):
    rows = judged(spark, d)
    return rounded(validation.mean_blend(rows.select("doc_id", "score").union(rows.select("doc_id", F.col("pred").cast("double"))), "doc_id", "score"), "score")


@register("ablation", f"WITH {JUDGED}, p AS (SELECT v, CAST(doc_id % 5 AS INT) AS fold, quality, CASE WHEN score >= CASE v WHEN 'base' THEN 0.5 ELSE 0.3 END THEN 1 ELSE 0 END AS pred FROM b, (SELECT unnest(['base', 'low']) AS v)), s AS (SELECT v, fold, count(*) FILTER (quality = 1 AND pred = 1) AS tp, count(*) FILTER (quality = 0 AND pred = 1) AS fp, count(*) FILTER (quality = 1 AND pred = 0) AS fn, count(*) FILTER (quality = 0 AND pred = 0) AS tn FROM p GROUP BY v, fold), m AS (SELECT v, fold, {scaled(fb(2))} AS m2 FROM s) SELECT m.v AS variant, round(avg(m.m2), 6) AS m2, round(avg(m.m2 - x.m2), 6) AS delta, count(*) FILTER (m.m2 > x.m2) AS folds_won FROM m JOIN m x ON x.v = 'base' AND x.fold = m.fold GROUP BY m.v")
def ablation(spark, d):
    rows = judged(spark, d).withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    each = relational.tag_union(base=rows, low=rows.withColumn("pred", relational.at_least(F.col("score"), 0.3)))
    got = validation.ablation(validation.fold_scores(each, "quality", "pred", ["tag", "fold"]), "tag", "base", ["fold"])
    return rounded(got.withColumnRenamed("tag", "variant"), "m2", "delta")


@register(
    "selective_centering",
    f"WITH {JUDGED}, g AS (SELECT source, count(*) AS n, avg(score) AS m FROM b GROUP BY source), u AS (SELECT p.source, avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) AS auc FROM b p JOIN b q ON p.source = q.source AND p.quality = 1 AND q.quality = 0 GROUP BY p.source), "
    "o AS (SELECT source, (m - (SELECT sum(n * m) / sum(n) FROM g)) * n / (n + 5) AS off FROM g JOIN u USING (source) WHERE round(auc, 9) >= 0.5) SELECT doc_id, round(greatest(0, least(1, score - coalesce(off, 0))), 6) AS centred FROM b LEFT JOIN o USING (source)",
)
def selective_centering(spark, d):
    rows = judged(spark, d)
    per = metrics.auc(rows, "quality", "score", ["source"]).withColumn("auc", F.round("auc", 9))
    return rounded(validation.selective_centering(rows, validation.group_offsets(rows, "source", "score"), per, "source", "score").select("doc_id", "centred"), "centred")


@register(
    "threshold_gap",
    f"WITH {JUDGED}, th AS (SELECT unnest(range(5, 96)) / 100 AS t), x AS (SELECT doc_id % 5 AS fold, t, {CLASS_COUNTS.replace('pred = 1', 'score >= t').replace('pred = 0', 'score < t')} FROM b, th GROUP BY 1, 2), m AS (SELECT fold, t, {scaled(fb(2))} AS m2 FROM x), "
    "p AS (SELECT fold, t, m2 FROM m QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(m2, 12) DESC, t) = 1) "
    "SELECT p.fold, round(p.t, 2) AS threshold, round(p.m2, 6) AS best, round(s.m2, 6) AS at_shipped, round(p.m2 - s.m2, 6) AS gap FROM p JOIN m s ON s.fold = p.fold AND round(s.t, 2) = 0.45",
)
def threshold_gap(spark, d):
    from sectiva.plans import applicability

    rows = judged(spark, d).withColumn("fold", F.col("doc_id") % 5)
    return rounded(applicability.threshold_gap(rows, "quality", "score", "m2", 0.45), "best", "at_shipped", "gap")


@register(
    "marked_mass",
    "WITH t AS (SELECT doc_id, doc_id % 2 AS side, unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM documents), n AS (SELECT count(*) AS n FROM documents WHERE doc_id % 2 = 0), "
    "f AS (SELECT doc_id, side, w, count(*) AS tf FROM t GROUP BY ALL), v AS (SELECT w, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM f, n WHERE side = 0 GROUP BY w HAVING count(*) >= 2), "
    "x AS (SELECT doc_id, w, tf * idf AS x FROM f JOIN v USING (w)), y AS (SELECT doc_id, w, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM x), "
    "r AS (SELECT doc_id, sum(x) AS s, sum(CASE WHEN regexp_matches(w, '[^ -~]') THEN x ELSE 0 END) AS m, count(*) AS k FROM y GROUP BY doc_id) "
    "SELECT d.doc_id % 2 AS side, round(sum(m) / sum(s), 6) AS mass, round(avg(coalesce(k, 0)), 6) AS active, count(*) FILTER (k IS NULL) AS zero_rows, count(*) AS n FROM documents d LEFT JOIN r USING (doc_id) GROUP BY 1",
)
def marked_mass(spark, d):
    # Dealt by key as texts, which are shorter than pairs of key and term; counting the pairs then moves nothing.
    docs = dealt(documents(spark, d).select("doc_id", "text"), "doc_id")
    rows = docs.select("doc_id", (F.col("doc_id") % 2).alias("side"), F.filter(F.split(F.lower("text"), " "), lambda x: x != "").alias("terms"))
    fitted = vectorize.TfIdf.fit(rows.filter("side = 0"), "doc_id", "terms", 2)
    return rounded(aggregates.marked_mass(fitted.weights(rows, "doc_id", "terms"), rows, "doc_id", "side", F.col("term").rlike("[^ -~]")), "mass", "active")


@register(
    "fuzzy_simulation",
    "WITH l AS (SELECT DISTINCT regexp_replace(substr(p_name, 1, 20), '[a-h]', '?', 'g') AS m, substr(p_name, 1, 20) AS c FROM part), a AS (SELECT m FROM l GROUP BY m HAVING count(*) = 1), k AS (SELECT DISTINCT m FROM l), "
    "p AS (SELECT a.m, k.m AS o, levenshtein(a.m, k.m) AS d FROM a, k WHERE a.m <> k.m AND abs(length(a.m) - length(k.m)) <= 4), q AS (SELECT m, o, d FROM p WHERE d <= 4 QUALIFY d = min(d) OVER (PARTITION BY m)), "
    "w AS (SELECT l.m, l.c, q.d, r.c AS other, list_distinct(list_filter(string_split(lower(l.c), ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(lower(r.c), ' '), lambda x: x <> '')) AS y FROM l JOIN q ON q.m = l.m JOIN l r ON r.m = q.o), "
    "s AS (SELECT m, d, len(list_intersect(x, y)) AS shared, len(list_distinct(list_concat(x, y))) AS either_, len(x) AS own FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY len(list_intersect(x, y)) DESC, other) = 1) "
    "SELECT d AS distance, count(*) AS n, round(avg(shared / greatest(either_, 1)), 6) AS jaccard, round(avg(shared / greatest(own, 1)), 6) AS recall, round(avg(CAST(shared = either_ AS INT)), 6) AS exact FROM s GROUP BY d",
)
def fuzzy_simulation(spark, d):
    lines = table(spark, d, "part").select(F.substring("p_name", 1, 20).alias("c")).withColumn("m", F.regexp_replace("c", "[a-h]", "?"))
    return rounded(decode.fuzzy_simulation(lines, "m", "c", 4), "jaccard", "recall", "exact")


@register(
    "subgroup_scores",
    f"WITH {JUDGED}, e AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS m, quantile_cont(n_chars, 0.75) AS z FROM b), o AS (SELECT b.*, CASE WHEN toxic = 1 THEN NULL ELSE toxic END AS field FROM b), "
    "s AS (SELECT quality, pred, 'n_chars:' || CASE WHEN n_chars <= a THEN 1 WHEN n_chars <= m THEN 2 WHEN n_chars <= z THEN 3 ELSE 4 END AS subgroup FROM o, e UNION ALL SELECT quality, pred, 'field:' || CASE WHEN field IS NULL THEN 'missing' ELSE 'present' END FROM o), "
    f"c AS (SELECT subgroup, {CLASS_COUNTS} FROM s GROUP BY subgroup) SELECT subgroup, n, tp, fp, fn, tn, round({fb(0.5)}, 6) AS macro_f05, round({fb(2)}, 6) AS macro_f2, round({scaled(fb(0.5))}, 6) AS m1, round({scaled(fb(2))}, 6) AS m2 FROM c",
)
def subgroup_scores(spark, d):
    rows = judged(spark, d).withColumn("field", F.when(F.col("toxic") == 0, F.col("toxic")))
    return rounded(metrics.subgroup_scores(rows, "quality", "pred", "n_chars", ["field"]), "macro_f05", "macro_f2", "m1", "m2")


@register(
    "fold_coverage",
    f"WITH {JUDGED}, f AS (SELECT *, doc_id % 5 AS fold, CAST(n_chars % 11 AS DOUBLE) / 11 AS covered FROM b), g AS (SELECT source, min(fold) AS lo, max(fold) AS hi FROM f GROUP BY source) "
    "SELECT fold, count(*) AS n, round(avg(quality), 6) AS rate, round(avg(CAST(lo < hi AS INT)), 6) AS seen_group_share, round(avg(covered), 6) AS coverage FROM f JOIN g USING (source) GROUP BY fold",
)
def fold_coverage(spark, d):
    rows = judged(spark, d).withColumns({"fold": F.col("doc_id") % 5, "covered": F.col("n_chars") % 11 / 11.0})
    return rounded(aggregates.fold_composition(rows, "fold", "quality", "source", "covered"), "rate", "seen_group_share", "coverage")


@register("duplicate_columns", "SELECT 'again' AS feature, 'n_chars' AS same_as UNION ALL SELECT 'n_letters', 'n_chars' WHERE (SELECT bool_and(n_chars IS NOT DISTINCT FROM length(text)) FROM documents) UNION ALL SELECT 'origin', 'lang' WHERE (SELECT bool_and(lang IS NOT DISTINCT FROM source) FROM documents)")
def duplicate_columns(spark, d):
    rows = table(spark, d, "documents").select("n_chars", F.length("text").cast("bigint").alias("n_letters"), "lang", F.col("source").alias("origin"), F.col("n_chars").alias("again"))
    return aggregates.duplicate_columns(rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns)), rows.columns)


@register("metric_shares", "SELECT c_custkey AS id, round((c_custkey % 30) / 49.0, 6) AS m2, round((c_custkey % 50 - c_custkey % 30) / 21.0, 6) AS m1 FROM customer")
def metric_shares(spark, d):
    k = F.col("c_custkey")
    parts = metrics.decomposition((k % 30).cast("double"), (k % 50).cast("double"))
    return rounded(table(spark, d, "customer").select(k.alias("id"), *(c.alias(n) for n, c in parts.items())), "m1", "m2")


@register("block_weights", "SELECT doc_id, 'size:' || lang AS term, CAST(n_chars * 0.25 AS DOUBLE) AS weight FROM documents")
def block_weights(spark, d):
    long = documents(spark, d).select("doc_id", F.col("lang").alias("term"), F.col("n_chars").cast("double").alias("weight"))
    return rounded(vectorize.block(long, "size", 0.25).select("doc_id", "term", "weight"), "weight")


@register("per_group_copies", "WITH k AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id)) SELECT doc_id, lang AS term, 1.0::DOUBLE AS weight FROM documents UNION ALL SELECT doc_id, source || '§' || lang, 1.0 FROM documents JOIN k USING (source)")
def per_group_copies(spark, d):
    docs = documents(spark, d)
    long = docs.select("doc_id", F.col("lang").alias("term"), F.lit(1.0).alias("weight"))
    return vectorize.per_group_copies(long, docs, "doc_id", "source", docs.join(table(spark, d, "labels"), "doc_id"))


@register("ordered_target_statistics", f"WITH {JUDGED} SELECT doc_id, round((coalesce(sum(quality) OVER p, 0) + 0.5) / (count(quality) OVER p + 1), 6) AS target_stat FROM b WINDOW p AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def ordered_target_statistics(spark, d):
    return rounded(models.ordered_target_statistics(judged(spark, d), "source", "quality", "doc_id").select("doc_id", "target_stat"), "target_stat")


@register("masked_title_rule", f"WITH {TITLES}, m AS (SELECT id, body, regexp_replace(title, '[А-яЁё]', '?', 'g') AS masked FROM w) SELECT id, CASE WHEN masked IN (SELECT masked FROM m WHERE contains(body, 'детей')) THEN 1 ELSE 0 END AS pred FROM m")
def masked_title_rule(spark, d):
    rows = formula_records(spark, d).select("id", "title_text", text.mask_cyrillic(F.col("title_text")).alias("masked"), F.lit(0).alias("pred"))
    return relational.member_rule(rows, rows.filter(F.col("title_text").contains("детей")), "masked", "pred").select("id", "pred")


# --- files ---------------------------------------------------------------------------------------


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("submission_round_trip", "SELECT c_custkey AS id, c_name || chr(10) || '\"' || c_mktsegment || '\"' AS title FROM customer")
def submission_round_trip(spark, d):
    path = _folder(spark, "submission")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('"')).alias("title"))
    files.write_submission(rows, path, ["id"], ["id", "title"])
    return files.read_table(spark, path, "id bigint, title string")


@register("manifest_bytes", "SELECT sum(length('{\"r\":' || r_regionkey || ',\"n\":\"' || r_name || '\"}') + 1)::BIGINT AS n_bytes, true AS valid_utf8, 0.0::DOUBLE AS high_share, false AS corrupted FROM region")
def manifest_bytes(spark, d):
    path = _folder(spark, "manifest")
    files.write_manifest(table(spark, d, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("n")), path)
    raw = files.binary(spark, path)
    return files.byte_profile(raw).join(files.is_corrupted(raw), "path").select(F.col("n_bytes").cast("long").alias("n_bytes"), "valid_utf8", "high_share", "corrupted")


@register(
    "response_problems",
    "WITH c AS (SELECT doc_id AS id, lang = 'en' AS ok FROM documents UNION ALL SELECT doc_id, true FROM labels) SELECT c_custkey AS id, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT id FROM c) UNION ALL "
    "SELECT DISTINCT id, 'unexpected' FROM c WHERE id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT id, 'duplicate' FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'malformed' FROM c WHERE NOT ok",
)
def response_problems(spark, d):
    good = F.lit('{"prediction": 1, "confidence": 0.5, "reasoning": "r"}')
    kept = documents(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", good).otherwise("not json").alias("raw_response"))
    again = table(spark, d, "labels").select(F.col("doc_id").alias("id"), good.alias("raw_response"))
    return files.validate_cache(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), kept.unionByName(again))


@register("stale_responses", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def stale_responses(spark, d):
    asked = documents(spark, d).select(F.col("doc_id").alias("id"), F.lit("v2").alias("prompt_version"))
    kept = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "v2").otherwise("v1").alias("prompt_version"))
    return files.stale(asked, kept, "id", "prompt_version")


@register("label_digests", f"WITH {JUDGED} SELECT lang, sha256(string_agg(CAST(pred AS VARCHAR), '' ORDER BY doc_id)) AS sha256 FROM b GROUP BY lang")
def label_digests(spark, d):
    return files.label_digest(judged(spark, d), "doc_id", "pred", ["lang"])


@register("text_limits", "SELECT count(*) FILTER (length(text) >= 5000) AS n_truncated, count(*) AS n, round(sum(length(text) - length(replace(text, 'a', ''))) / sum(length(text)), 6) AS share FROM documents")
def text_limits(spark, d):
    marked = documents(spark, d).select(F.translate("text", "a", "?").alias("text"))
    return rounded(files.truncated(marked, "text", 5000).crossJoin(files.question_guard(marked, ["text"]).select("share")), "share")


@register("fold_files", "SELECT CAST(n_nationkey % 3 AS INT) AS fold, CAST(n_nationkey AS INT) AS row FROM nation")
def fold_files(spark, d):
    path = _folder(spark, "folds")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    each = [F.struct(F.array_sort(F.collect_list(F.when(F.col("k") % 3 != i, F.col("k")))).alias("train_idx"), F.array_sort(F.collect_list(F.when(F.col("k") % 3 == i, F.col("k")))).alias("val_idx")) for i in range(3)]
    rows.agg(F.to_json(F.array(*each)).alias("value")).write.text(path)
    return files.read_folds(spark, path)


@register("byte_fingerprints", "SELECT sha256(string_agg('{\"r\":' || r_regionkey || ',\"n\":\"Ж\"}' || chr(10), '' ORDER BY r_regionkey)) AS sha256, '96,D0' AS high, true AS same FROM region")
def byte_fingerprints(spark, d):
    path = _folder(spark, "fingerprint")
    files.write_manifest(table(spark, d, "region").orderBy("r_regionkey").select(F.col("r_regionkey").alias("r"), F.lit("Ж").alias("n")), path)
    raw = files.binary(spark, path)
    return files.fingerprint(raw).select("sha256", F.array_join("high_bytes", ",").alias("high"), F.lit(files.unchanged(raw, raw)).alias("same"))


@register("appended_log", "SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def appended_log(spark, d):
    path = _folder(spark, "log")
    rows = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    files.append_log(rows, path)
    files.append_log(rows, path)
    return spark.read.parquet(path)


@register("cached_scores", f"WITH {JUDGED} SELECT doc_id, score, pred FROM b")
def cached_scores(spark, d):
    rows, path = judged(spark, d).select("doc_id", "score", "pred"), _folder(spark, "scores")
    models.cached(spark, path, {"c": 1}, "data", lambda: rows)
    return models.cached(spark, path, {"c": 1}, "data", lambda: rows.withColumn("pred", F.lit(None).cast("int")))

"""What a title demands against what a record states: satisfied, contradicted or unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectiva.functions.records import record_fields
from sectiva.functions.text import NEGATION, first_group, flag, hits, lemma_map, near_spans, record_words, sorted_prefix, spans, text

# Levels of severity words, generic words, topics of one sex, markers of pregnancy.
SEVERITY = {
    1: "легкий лёгкий легкая лёгкая легкое",
    2: "среднетяжелый среднетяжёлый умеренный умеренная средний средняя",
    3: "тяжелый тяжёлый тяжелая тяжёлая тяжелое выраженный выраженная",
}
GENERIC = (
    "клинический рекомендация лечение особенность пациент терапия взрослый категория возрастной консервативный "
    "хирургический медикаментозный группа локализация форма период снизить кроме прочий другой определённый"
).split()
FEMALE_TOPICS = ("эндометриоз", "беремен", "контрацептив", " мгт", "ддмж", "молочн", "маточ", "яичник", "гинеколог")
MALE_TOPICS = ("простат", "мужского пола")
PREGNANCY = ("беремен", "грудно", "лактац", "кормлен")
CONTRADICTION = (
    "age_contradiction", "gender_condition_present", "gender_unknown", "severity_match", "severity_contradiction", "severity_unknown",
    "condition_overlap", "condition_contradiction", "condition_unknown", "contradiction_count", "contradiction_density",
)


def any_of(c: Column, literals) -> Column:
    ok = F.lit(False)
    for x in literals:
        ok = ok | c.contains(x)
    return ok


def title_age_bound(c: Column) -> Column:
    return first_group(text(c), r"(?iU)до\s*(\d{1,3})\s*лет").cast("double")


def title_required_gender(c: Column) -> Column:
    low = F.lower(text(c))
    return F.when(any_of(low, FEMALE_TOPICS), F.lit("F")).when(any_of(low, MALE_TOPICS), F.lit("M"))


def is_pregnancy(c: Column) -> Column:
    return any_of(F.lower(text(c)), PREGNANCY)


def severity_level(lemmas: Column) -> Column:
    """Highest level among lemmas; null without a severity word."""
    level = F.lit(None).cast("int")
    for n, ws in sorted(SEVERITY.items()):
        level = F.when(F.arrays_overlap(lemmas, F.array(*map(F.lit, ws.split()))), F.lit(n)).otherwise(level)
    return level


def condition_terms(lemmas: Column) -> Column:
    return F.array_distinct(F.filter(lemmas, lambda t: (F.length(t) > 3) & ~t.isin(*GENERIC)))


def contradiction_features(df: DataFrame, title="title_text", title_lemmas="title_lemma", narrative="narrative_text", narrative_lemmas="narrative_lemma", age="age", gender="gender_raw", keep=None) -> DataFrame:
    """``df`` with the eleven contradiction features.

    Lemma columns are arrays.  A null age or sex is unknown, which never contradicts; of the shared
    disease terms the first five in order are searched near negations of the raw narrative.
    """
    t = F.col(title)
    d = df.withColumns(
        {
            "_bound": title_age_bound(t), "_required": title_required_gender(t), "_preg": is_pregnancy(t), "_tsev": severity_level(F.col(title_lemmas)), "_nsev": severity_level(F.col(narrative_lemmas)),
            "_terms": condition_terms(F.col(title_lemmas)), "_low": F.lower(text(F.col(narrative))),
        }
    )
    d = d.withColumns({"_shared": sorted_prefix(F.col("_terms"), F.col(narrative_lemmas)), "_neg": spans(F.col("_low"), NEGATION)})
    req, ts, ns, n_terms = F.col("_required"), F.col("_tsev"), F.col("_nsev"), F.size("_terms")
    d = d.withColumns(
        {
            "age_contradiction": flag(F.col(age) > F.col("_bound")),
            "gender_condition_present": flag(req.isNotNull()),
            "gender_unknown": flag(req.isNotNull() & (F.col(gender).isNull() | F.col("_preg"))),
            "_gender_contradiction": flag(req != F.col(gender)),
            "severity_match": flag(ts == ns),
            "severity_contradiction": flag(ts != ns),
            "severity_unknown": flag(ts.isNotNull() & ns.isNull()),
            "condition_overlap": flag(F.size("_shared") > 0),
            "condition_contradiction": flag(F.exists("_shared", lambda tok: near_spans(F.col("_low"), F.col("_neg"), tok))),
        }
    )
    d = d.withColumn("condition_unknown", flag((F.col("condition_overlap") == 0) & (n_terms > 0)))
    d = d.withColumn("contradiction_count", F.col("age_contradiction") + F.col("_gender_contradiction") + F.col("severity_contradiction") + F.col("condition_contradiction"))
    rules = flag(F.col("_bound").isNotNull()) + flag(req.isNotNull()) + flag(ts.isNotNull()) + flag(n_terms > 0)
    d = d.withColumn("contradiction_density", F.coalesce(F.try_divide(F.col("contradiction_count"), rules), F.lit(0.0)))
    return d.select(*(keep or df.columns), *CONTRADICTION)


def applicability_frame(df: DataFrame, title="title_text", record="protocol_text", lemmas: dict[str, str] | Column | None = None, record_lemmas: Column | None = None) -> DataFrame:
    """``df`` with lemmas, record fields and contradiction features: the input of the second stage.

    ``lemmas`` is a dictionary, or a column with a map of the title's words; then ``record_lemmas`` is one of the record's.
    """
    of_record = lemmas if record_lemmas is None else record_lemmas
    d = df.withColumns({"title_lemma": lemma_map(record_words(F.col(title)), lemmas), **record_fields(F.col(record))})
    d = d.withColumns({"narrative_lemma": lemma_map(record_words(F.col("narrative_text")), of_record), "gender": F.coalesce("gender_raw", F.lit("unknown"))})
    return contradiction_features(d, title)


def shared_over_limit(a: Column, b: Column, limit: int = 5) -> Column:
    """Whether more tokens are shared than the search looks at."""
    return flag(F.size(F.array_intersect(a, b)) > limit)


def negation_geometry(df: DataFrame, terms: str, record: str) -> DataFrame:
    """``df`` with distances between occurrences of terms (array column) and negations of a record."""
    d = df.withColumn("_low", F.lower(text(F.col(record)))).withColumn("_neg", spans(F.col("_low"), NEGATION))
    each = F.transform(F.array_sort(F.array_distinct(terms)), lambda t: F.struct(t.alias("t"), hits(F.col("_low"), t).alias("at")))
    d = d.withColumn("_hits", F.flatten(F.transform(each, lambda x: F.transform(x["at"], lambda i: F.struct(x["t"].alias("t"), i.alias("s"), (i + F.length(x["t"])).alias("e"))))))

    def gap(hit, neg):
        before, after = neg["e"] <= hit["s"], neg["s"] >= hit["e"]
        dist = F.when(before, hit["s"] - neg["e"]).when(after, neg["s"] - hit["e"]).otherwise(0)
        return F.struct(dist.alias("d"), (~after).alias("before"), (~before & after).alias("after"))

    d = d.withColumn("_gaps", F.flatten(F.transform("_hits", lambda hit: F.transform("_neg", lambda neg: gap(hit, neg)))))
    best = F.array_min(F.transform("_gaps", lambda g: g["d"]))
    matched = F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["t"])))
    out = {
        "n_condition_tokens": F.size(F.array_distinct(terms)), "condition_present": flag(F.size("_hits") > 0), "condition_present_count": F.size("_hits"), "condition_tokens_matched": F.array_join(matched, "|"),
        "n_condition_tokens_matched": F.size(matched), "negation_count_total": F.size("_neg"), "nearest_negation_distance": best.cast("double"),
        "neg_before_condition": flag(F.exists("_gaps", lambda g: g["before"] & (g["d"] <= 50))), "neg_after_condition": flag(F.exists("_gaps", lambda g: g["after"] & (g["d"] <= 50))),
        **{f"neg_within_{k}": flag(best <= k) for k in (5, 10, 20, 50)}, "condition_negated_exact": flag(best <= 40),
    }
    return d.withColumns(out).drop("_low", "_neg", "_hits", "_gaps")

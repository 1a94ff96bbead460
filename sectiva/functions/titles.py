"""Hierarchical titles: positional parts, layout features, masked shapes, condition groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sectiva.functions.text import count_of, flag, found, lemma_map, let, mask_cyrillic, split_words, strip, text, title_words

# Lemmas that name a condition of a patient, by group.
CONDITION_GROUPS = {
    "age": "ребёнок ребенок детский взрослый новорождённый новорожденный подросток год старше младше пожилой грудной младенец",
    "gender": "женщина мужчина беременный беременность кормящий лактация женский мужской роды послеродовой",
    "severity": "тяжёлый тяжелый лёгкий легкий среднетяжёлый среднетяжелый степень стадия выраженный критический",
    "form": "форма тип вариант подтип течение фенотип",
    "comorbidity": "сопутствующий недостаточность осложнение осложнённый осложненный сахарный диабет почечный печёночный печеночный сочетанный",
    "refractory": "рецидив резистентный рефрактерный повторный неэффективность",
    "restriction": "при случай пациент группа наличие",
}
LATIN_RUN, ANY_DIGIT = "[A-Za-z]{2,}", r"(?U)\d"


def parse_title(c: Column) -> Column:
    """STRUCT<guideline, age_category, hierarchy, depth, subsection, body, n_lines> of a multi-line title.

    Positions decide: first line, second line, last line, what is between.  A single line is padded
    by an empty one, which then is both the age line and the subsection.
    """

    def parts(lines: Column) -> Column:
        sub = F.element_at(lines, -1)
        inner = F.when(F.size(lines) > 3, F.slice(lines, F.lit(3), F.size(lines) - 3)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.get(lines, F.lit(0)).alias("guideline"),
            F.get(lines, F.lit(1)).alias("age_category"),
            inner.alias("hierarchy"),
            F.length(F.regexp_extract(sub, "^#*", 0)).alias("depth"),
            sub.alias("subsection"),
            strip(F.regexp_replace(sub, "^[# ]+", "")).alias("body"),
            (F.lit(3) + F.size(inner)).alias("n_lines"),
        )

    raw = F.transform(F.split(text(c), "\n", -1), strip)
    return let(raw, lambda x: let(F.when(F.size(x) < 2, F.concat(x, F.array(F.lit("")))).otherwise(x), parts))


def guideline_name(c: Column) -> Column:
    return F.get(F.split(strip(text(c)), "\n", -1), F.lit(0))


def title_context(p: Column) -> Column:
    return F.concat_ws(" ", p["guideline"], p["age_category"], F.array_join(p["hierarchy"], " "))


def group_counts(lemmas: Column) -> Column:
    """MAP of group to the number of distinct lemmas of a title in it."""
    return F.create_map(*(x for g, ws in sorted(CONDITION_GROUPS.items()) for x in (F.lit(g), F.size(F.array_intersect(lemmas, F.array(*map(F.lit, ws.split())))))))


def n_groups(lemmas: Column) -> Column:
    """How many groups a title's lemmas touch."""
    touched = [flag(F.arrays_overlap(lemmas, F.array(*map(F.lit, ws.split())))) for ws in CONDITION_GROUPS.values()]
    return sum(touched[1:], touched[0])


def struct_features(c: Column, lemmas: dict[str, str] | Column | None = None) -> dict[str, Column]:
    """The 13 layout and condition features of a title."""
    p, s = parse_title(c), text(c)
    body = p["body"]
    known = lambda x: lemma_map(title_words(x), lemmas)
    return {
        "depth": p["depth"], "n_lines": p["n_lines"], "len_title": F.length(s), "len_subsection": F.length(body), "n_words_subsection": F.size(split_words(body)),
        "n_words_guideline": F.size(split_words(p["guideline"])), "has_latin": flag(body.rlike(LATIN_RUN)), "has_digit": flag(body.rlike(ANY_DIGIT)),
        "n_parens": count_of(body, "("), "n_commas": count_of(body, ","), "n_quotes": count_of(s, '"'),
        "n_cond_groups_sub": n_groups(known(body)), "n_cond_groups_ctx": n_groups(known(title_context(p))),
    }


def skeleton_features(c: Column) -> dict[str, Column]:
    """23 counts and lengths of a masked title; a title without words has zeros."""
    p = parse_title(mask_cyrillic(c))
    body, guide = p["body"], p["guideline"]
    sizes = F.transform(split_words(body), lambda w: F.length(w))
    n = F.size(sizes)
    long_ = F.size(F.filter(sizes, lambda x: x >= 10))
    zero = F.lit(0)
    return {
        "depth": p["depth"], "n_lines": p["n_lines"], "len_guideline": F.length(guide), "len_subsection": F.length(p["subsection"]), "len_body": F.length(body), "n_words_body": n,
        "mean_word_len": F.coalesce(F.try_divide(F.aggregate(sizes, zero, lambda a, x: a + x), n), F.lit(0.0)), "max_word_len": F.coalesce(F.array_max(sizes), zero), "min_word_len": F.coalesce(F.array_min(sizes), zero),
        "n_parens": count_of(body, "("), "n_commas": count_of(body, ","), "n_dashes": count_of(body, "-"), "n_colons": count_of(body, ":"), "n_digits_body": F.size(found(body, ANY_DIGIT)), "n_quotes": count_of(body, '"'),
        "has_latin_body": flag(body.rlike(LATIN_RUN)), "has_digit_body": flag(body.rlike(ANY_DIGIT)), "n_guideline_parens": count_of(guide, "("), "n_guideline_commas": count_of(guide, ","), "n_words_guideline": F.size(split_words(guide)),
        "n_long_words": long_, "n_short_words": F.size(F.filter(sizes, lambda x: x <= 3)), "long_word_ratio": F.coalesce(F.try_divide(long_, n), F.lit(0.0)),
    }


def meta_features(c: Column) -> dict[str, Column]:
    """Six features of a raw title."""
    s = text(c)
    return {
        "len_chars": F.length(s), "n_newlines": count_of(s, "\n"), "has_latin": flag(s.rlike(LATIN_RUN)), "has_digit": flag(s.rlike(ANY_DIGIT)), "n_quotes": count_of(s, '"'),
        "max_word_len": F.coalesce(F.array_max(F.transform(split_words(s), lambda w: F.length(w))), F.lit(0)),
    }


def word_shape(w: Column) -> Column:
    mark = lambda ok, x: F.when(ok, F.lit(x)).otherwise("")
    return F.concat(F.lit("w"), F.length(w).cast("string"), mark(w.contains("("), "p"), mark(w.contains(","), "c"), mark(w.rlike(ANY_DIGIT), "d"))


def invariant_tokens(c: Column) -> Column:
    """Bag of tokens that masking leaves alone: depth, age line, sizes and word shapes."""
    num = lambda tag, x: F.concat(F.lit(tag), x.cast("string"))

    def tokens(p: Column, body: Column, ws: Column) -> Column:
        fixed = [
            num("D", p["depth"]), F.concat(F.lit("AGE="), p["age_category"]), num("NW", F.least(F.size(ws), F.lit(20))), num("LEN", F.least(F.floor(F.length(body) / 10), F.lit(15))), num("NL", p["n_lines"]),
            F.when(body.rlike(LATIN_RUN), F.lit("HASLATIN")), F.when(body.rlike(ANY_DIGIT), F.lit("HASDIGIT")),
        ]
        return F.concat_ws(" ", *fixed, F.transform(ws, word_shape))

    # The title is parsed, and its body split, once; a lambda's body would do so again for each use.
    return let(parse_title(mask_cyrillic(c)), lambda p: let(split_words(p["body"]), lambda ws: tokens(p, p["body"], ws)))

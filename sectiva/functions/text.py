"""Column builders for plain text: trimming, words, counts, matches with their places."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word patterns, stop words and the negation pattern of the Russian pack.
TITLE_WORD = r"(?U)[^\W\d_]+"
RECORD_WORD = "[а-яёa-z]+"
STOPWORDS = tuple(
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее "
    "мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть "
    "был него до вас нибудь опять уж вам для при".split()
)
NEGATION = r"(?iU)\bне\s+\w+|\bнет\s+\w+|отсутств\w*|отрицательн\w*|не\s+выявлен\w*|не\s+определя\w*"
CYRILLIC = "[А-яЁё]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flag(condition: Column) -> Column:
    """A condition as 0 or 1; unknown is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def split_words(c: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def count_of(c: Column, what: str) -> Column:
    """Occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int")


def found(c: Column, pattern: str) -> Column:
    """All matches of a pattern, whole."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where the pattern doesn't match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def last_line(c: Column) -> Column:
    return F.element_at(F.split(strip(text(c)), "\n", -1), -1)


def heading_depth(c: Column) -> Column:
    return F.length(F.regexp_extract(last_line(c), "^#*", 0))


def normalise(c: Column) -> Column:
    """Lower case, white space collapsed."""
    return strip(F.regexp_replace(F.lower(text(c)), r"(?U)\s+", " "))


def title_words(c: Column) -> Column:
    """Lower-case words of letters, function words kept."""
    return found(F.lower(text(c)), TITLE_WORD)


def record_words(c: Column, stopwords=STOPWORDS) -> Column:
    """Lower-case Cyrillic and Latin words without stop words; the test comes before any lemma."""
    return F.filter(found(F.lower(text(c)), RECORD_WORD), lambda w: ~w.isin(*stopwords))


def hash_tokens(c: Column) -> Column:
    """Lower-case tokens with heading marks blanked."""
    return split_words(F.lower(F.replace(text(c), F.lit("#"), F.lit(" "))))


def mask_cyrillic(c: Column) -> Column:
    return F.regexp_replace(text(c), CYRILLIC, "?")


def lemma_map(words: Column, lemmas: Mapping[str, str] | Column | None) -> Column:
    """Words through a small dictionary, or through a column with a map; unknown words stay."""
    if isinstance(lemmas, Column):
        return F.transform(words, lambda w: F.coalesce(F.try_element_at(lemmas, w), w))
    if not lemmas:
        return words
    table = F.create_map(*(F.lit(x) for kv in lemmas.items() for x in kv))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def lemmatise(df: DataFrame, key: str, words: str, lemmas: DataFrame, out: str = "lemmas") -> DataFrame:
    """``df`` with the lemmas of an array of words, by a dictionary table (token, lemma) of any size.

    Each distinct token is looked up once; order is kept; tokens without an entry stay.
    """
    rows = df.select(F.col(key).alias("_k"), F.posexplode(words).alias("_pos", "_token"))
    known = rows.select("_token").distinct().join(lemmas.select(F.col("token").alias("_token"), "lemma").dropDuplicates(["_token"]), "_token", "left")
    merged = rows.join(known, "_token").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("lemma", "_token").alias("l")))).alias("_all"))
    merged = merged.select(F.col("_k"), F.transform("_all", lambda x: x["l"]).alias(out))
    return df.join(merged, df[key] == merged["_k"], "left").drop("_k").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def spans(c: Column, pattern: str) -> Column:
    """Array of (s, e): where a pattern matches, in characters from 0, end exclusive."""
    pairs = F.filter(F.arrays_zip(F.split(c, pattern, -1).alias("gap"), found(c, pattern).alias("hit")), lambda x: x["hit"].isNotNull())
    sizes = F.transform(pairs, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("n")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e")))).alias("out"))

    return F.when(~c.rlike(pattern), none).otherwise(F.aggregate(sizes, start, step, lambda acc: acc["out"]))


def negation_count(c: Column) -> Column:
    return F.size(found(text(c), NEGATION))


def negation_spans(c: Column) -> Column:
    return spans(text(c), NEGATION)


def near_spans(c: Column, where: Column, token: Column, window: int = 40) -> Column:
    """Whether a token lies within ``window`` characters of any span."""
    lo = lambda x: F.greatest(F.lit(0), x["s"] - window)
    return F.exists(where, lambda x: F.contains(c.substr(lo(x) + 1, x["e"] + window - lo(x)), token))


def hits(c: Column, token: Column) -> Column:
    """Offsets of a token in a text, overlapping ones included."""
    pieces = F.split(c, F.concat(F.lit("(?=\\Q"), token, F.lit("\\E)")), -1)
    lengths = F.transform(pieces, lambda p: F.length(p))
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
    inner = F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))
    return F.when(F.length(token) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.concat(F.when(c.startswith(token), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), inner), lambda i: i >= 0))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def token_recall(truth: Column, guess: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(truth, guess)), F.size(F.array_distinct(truth)))


def sorted_prefix(a: Column, b: Column, k: int = 5) -> Column:
    """The first ``k`` shared tokens in code-point order: the same in every run."""
    return F.slice(F.array_sort(F.array_intersect(a, b)), 1, k)


def capped_levenshtein(a: Column, b: Column, cap: int) -> Column:
    """Edit distance; ``cap`` + 1 where it is over ``cap``."""
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, F.lit(cap + 1)).otherwise(d)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))

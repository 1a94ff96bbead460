"""Term weighting, n-grams, scaling and encoding with explicit semantics, in long or vector form.

Vectors have the same weights as the usual text toolkit: smooth inverse document frequency plus
one, optional sublinear counts, unit length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectiva.functions.text import let, text
from sectiva.operators.ordered import dense_ranks
from sectiva.operators.quantiles import quantiles


def word_ngrams(tokens: Column, lo: int = 1, hi: int = 1, min_chars: int = 2) -> Column:
    """Space-joined n-grams of the tokens with at least ``min_chars`` characters."""

    def of(kept: Column, n: int) -> Column:
        starts = F.when(F.size(kept) >= n, F.sequence(F.lit(1), F.size(kept) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(kept, i, F.lit(n)), " "))

    return let(F.filter(tokens, lambda t: F.length(t) >= min_chars), lambda kept: F.flatten(F.array(*(of(kept, n) for n in range(lo, hi + 1)))))


def char_wb_ngrams(c: Column, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams inside words padded by a blank on either side; a word shorter than n gives itself once."""
    words = F.transform(F.filter(F.split(F.lower(text(c)), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column, n: int) -> Column:
        full = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: w.substr(i, F.lit(n)))
        return full if n == lo else F.when(F.length(w) > n - 1, full).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(words, lambda w: F.flatten(F.array(*(of(w, n) for n in range(lo, hi + 1))))))


@dataclass
class TfIdf:
    """A fitted vocabulary: (term, df, idf, index), and how counts are weighted."""

    vocabulary: DataFrame
    sublinear: bool

    @classmethod
    def fit(cls, docs: DataFrame, key: str, terms: str, min_df: int = 2, max_features: int | None = None, sublinear: bool = False) -> TfIdf:
        """Document frequencies over ``docs`` (one row a key); the most frequent terms if there are too many."""
        n = docs.agg(F.count("*").alias("_n"))
        each = docs.select(F.col(key).alias("_k"), F.explode(terms).alias("term")).groupBy("_k", "term").agg(F.count("*").alias("tf"))
        df = each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("_total")).filter(F.col("df") >= min_df)
        if max_features:
            df = df.orderBy(F.desc("_total"), "term").limit(max_features)
        vocabulary = df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
        return cls(vocabulary, sublinear)

    def weights(self, docs: DataFrame, key: str, terms: str) -> DataFrame:
        """(key, term, weight): unit-length weights of the known terms of each row."""
        rows = docs.select(F.col(key), F.col(terms).alias("_t")).filter(F.col(key).isNotNull())
        each = rows.select(key, F.explode("_t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
        tf = 1 + F.log("tf") if self.sublinear else F.col("tf").cast("double")
        raw = each.join(self.vocabulary, "term").select(key, "term", (tf * F.col("idf")).alias("_w"))
        # Known terms go to their row once; its length is taken there.
        norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
        return raw.select(key, "term", (F.col("_w") / norm).alias("weight"))


def feature_index(long: DataFrame, feature: str = "term") -> DataFrame:
    """(feature, index): features numbered by name, in ranges."""
    return dense_ranks(long.select(feature).distinct(), feature, "index")


def to_vectors(long: DataFrame, key: str, index: DataFrame, size: int, feature: str = "term", value: str = "weight", out: str = "features") -> DataFrame:
    """(key, features): vectors of long weights; they are dense inside, so ``size`` should be moderate."""
    rows = long.join(index, feature).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("index").cast("int").alias("i"), F.col(value).cast("double").alias("v")))).alias("_x"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_x"), i), F.lit(0.0)))
    return rows.select(key, array_to_vector(filled).alias(out))


@dataclass
class Scaler:
    """Medians for missing values (found only if some are missing), then means and population deviations."""

    stats: dict[str, tuple[float, float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> Scaler:
        gaps = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns))).first()
        values = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)))).alias("v")
        found = {r.i: r.q0 for r in quantiles(df.select(values).select("v.i", "v.x"), "x", [0.5], ["i"]).collect()} if any(gaps) else {}
        medians = {c: found.get(i) or 0.0 for i, c in enumerate(columns)}
        filled = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))).alias(c) for c in columns))
        got = filled.agg(*(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s")))).first()
        return cls({c: (float(medians[c]), got[f"{c}_m"] or 0.0, got[f"{c}_s"] or 1.0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(m)) - mean) / sd for c, (m, mean, sd) in self.stats.items()})


def one_hot(df: DataFrame, key: str, column: str, levels: DataFrame) -> DataFrame:
    """(key, term, weight) of categories among ``levels``; an unknown one has no entry."""
    return df.select(key, F.col(column).alias(column)).join(levels.select(column).distinct(), column).select(key, F.concat(F.lit(f"{column}="), F.col(column).cast("string")).alias("term"), F.lit(1.0).alias("weight"))


def numeric_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("weight")) for c in columns)))
    return df.select(key, rows.alias("x")).select(key, "x.term", "x.weight")


def block(long: DataFrame, name: str, weight: float = 1.0) -> DataFrame:
    """Features of a block, named apart and weighted; weight 0 switches the block off."""
    d = long.withColumn("term", F.concat(F.lit(f"{name}:"), "term")).withColumn("weight", F.col("weight") * weight)
    return d.filter("weight <> 0") if weight else d.limit(0)


def per_group_copies(long: DataFrame, groups: DataFrame, key: str, group: str, known: DataFrame) -> DataFrame:
    """Features, and a copy of each for its row's group; a group that ``known`` hasn't gets no copy."""
    hit = long.join(groups.select(key, group), key).join(known.select(group).distinct(), group)
    copies = hit.select(key, F.concat(F.col(group).cast("string"), F.lit("§"), "term").alias("term"), "weight")
    return long.select(key, "term", "weight").unionByName(copies)


def noise(df: DataFrame, seed: int = 0, out: str = "noise") -> DataFrame:
    """A control feature without signal."""
    return df.withColumn(out, F.randn(seed))


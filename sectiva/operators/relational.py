"""Filters, lookups, semi- and anti-joins, set operations and ordered picks, all keyed by explicit columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectiva.functions.text import capped_levenshtein, flag
from sectiva.operators.ordered import dense_ranks


def at_least(score: Column, threshold: float) -> Column:
    """A score as a 0/1 prediction."""
    return flag(score >= threshold)


def outcome(label: Column, pred: Column) -> Column:
    """TP, TN, FP or FN."""
    return F.when((label == 1) & (pred == 1), "TP").when((label == 0) & (pred == 0), "TN").when(pred == 1, "FP").otherwise("FN")


def overwrite(value: Column, mask: Column, new: Column) -> Column:
    return F.when(mask, new).otherwise(value)


def clip(c: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(c, F.lit(hi)))


def bucket(c: Column, width: int, cap: int) -> Column:
    """``c // width``, at most ``cap``."""
    return F.least(F.floor(c / width), F.lit(cap)).cast("int")


def count_label(n: Column) -> Column:
    """0, 1, 2-3 or 4+ candidates."""
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")


def pair_key(*parts: Column) -> Column:
    return F.concat_ws("||", *parts)


def factorise(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Dense codes of a column's values by value; nulls get none.

    Distinct values are numbered in ranges (``ordered``) and joined back, so no task ranks all of them.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return df.join(dense_ranks(values, column, out), column, "left")


def suffixed_join(a: DataFrame, b: DataFrame, *keys: str, suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner") -> DataFrame:
    """Join on keys; columns of both sides that share a name get a suffix."""
    shared = (set(a.columns) & set(b.columns)) - set(keys)
    named = lambda df, suffix: df.withColumnsRenamed({c: f"{c}{suffix}" for c in shared})
    return named(a, suffixes[0]).join(named(b, suffixes[1]), list(keys), how)


def hard_override(df: DataFrame, pred: str, rules: list[tuple[Column, int]]) -> DataFrame:
    """Predictions replaced by the value of the first rule that holds; a null condition doesn't hold."""
    case = F.when(F.lit(False), F.col(pred))
    for holds, value in rules:
        case = case.when(holds, F.lit(value))
    return df.withColumn(pred, case.otherwise(F.col(pred)))


def label_differences(a: DataFrame, b: DataFrame, key: str, label: str, by: list[str] | None = None) -> DataFrame:
    """How often two sets of labels have each pair of values, by group; a key that one side lacks counts with null."""
    joined = a.select(key, *(by or []), F.col(label).alias("a")).join(b.select(key, *(by or []), F.col(label).alias("b")), [key, *(by or [])], "full")
    return joined.groupBy(*(by or []), "a", "b").agg(F.count("*").alias("n"))


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, or an error if a key repeats."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{', '.join(keys)} must be unique")
    return df


def left_lookup(df: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join that keeps the rows of ``df`` as they are: keys on the right must be unique."""
    return df.join(assert_unique(right, *keys), list(keys), "left")


def strict_lookup(df: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join that raises if a key of ``df`` is missing on the right."""
    if df.join(right, list(keys), "left_anti").limit(1).count():
        raise KeyError("keys are missing on the right")
    return df.join(assert_unique(right, *keys), list(keys))


def lookup_default(df: DataFrame, right: DataFrame, key: str, column: str, default) -> DataFrame:
    return df.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def flag_members(df: DataFrame, members: DataFrame, key: str, out: str = "hit") -> DataFrame:
    """0/1 for rows whose key is in ``members``; a null key is no member."""
    m = members.select(F.col(key).alias("_m")).filter("_m is not null").distinct().withColumn("_in", F.lit(1))
    return df.join(m, F.col(key) == F.col("_m"), "left").withColumn(out, F.coalesce("_in", F.lit(0))).drop("_m", "_in")


def member_rule(df: DataFrame, members: DataFrame, key: str, pred: str, enabled: bool = True) -> DataFrame:
    """Predictions overwritten by 1 for members, if the rule is enabled."""
    if not enabled:
        return df
    hit = flag_members(df, members, key, "_hit")
    return hit.withColumn(pred, overwrite(F.col(pred), F.col("_hit") == 1, F.lit(1))).drop("_hit")


def audit_rule(df: DataFrame, members: DataFrame, key: str, label: str) -> DataFrame:
    """One row: coverage, precision, and whether the rule may be enabled (precision exactly 1)."""
    hit = flag_members(df, members, key, "_hit")
    covered = F.sum("_hit")
    right = F.sum(F.col("_hit") * F.col(label))
    return hit.agg(covered.alias("covered"), F.try_divide(right, covered).alias("precision"), F.coalesce(right == covered, F.lit(False)).alias("enabled"))


def unseen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``known`` hasn't."""
    return df.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def flips(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose labels differ between two sources."""
    return a.select(key, F.col(column).alias("before")).join(b.select(key, F.col(column).alias("after")), key).filter("before <> after")


def overlap_counts(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """One row: distinct values of each key that both sides have; values are compared by digest, so long texts aren't shuffled."""
    digest = lambda df, k: df.select(F.sha2(F.col(k).cast("string"), 256).alias("d"))
    parts = [digest(a, k).intersect(digest(b, k)).agg(F.count("*").alias(f"shared_{k}")) for k in keys]
    return reduce(lambda x, y: x.crossJoin(y), parts)


def near_pairs(queries: DataFrame, corpus: DataFrame, query: str, key: str, cap: int = 6) -> DataFrame:
    """(q, k, d): distinct queries and keys within ``cap`` edits, with their distance.

    A key within ``cap`` edits shares one of ``cap`` + 1 pieces of the query with it, shifted by at
    most ``cap``; so candidates come from an equi-join of pieces, and only those are compared.
    Queries too short for such pieces are compared with the short keys alone.
    """
    n = cap + 1
    q = queries.select(F.col(query).alias("q")).distinct()
    k = corpus.select(F.col(key).alias("k")).distinct()
    size = F.floor(F.length("q") / n).cast("int")
    pieces = q.filter(F.length("q") >= 2 * n).select("q", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cap)), lambda i: F.struct((i * size).alias("at"), F.col("q").substr(i * size + 1, size).alias("piece")))).alias("p"), size.alias("size"))
    spots = k.join(pieces.select("size").distinct(), F.abs(F.length("k") - F.col("size") * n) <= n + cap).select("k", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.length("k") - F.col("size"), F.lit(0)))).alias("at"))
    spots = spots.select("k", "size", "at", F.col("k").substr(F.col("at") + 1, F.col("size")).alias("piece"))
    near = pieces.select("q", "size", "p.*").join(spots.withColumnRenamed("at", "at_k"), ["size", "piece"]).filter(F.abs(F.col("at") - F.col("at_k")) <= cap).select("q", "k").distinct()
    short = q.filter(F.length("q") < 2 * n).join(k.filter(F.length("k") < 2 * n + cap), F.abs(F.length("q") - F.length("k")) <= cap)
    return near.unionByName(short.select("q", "k")).select("q", "k", capped_levenshtein(F.col("q"), F.col("k"), cap).alias("d")).filter(F.col("d") <= cap)


def nearest_edit(queries: DataFrame, corpus: DataFrame, query: str, key: str, cap: int = 6) -> DataFrame:
    """(query, distance): least capped edit distance of each query to a corpus of keys; ``cap`` + 1 if none is within ``cap``."""
    best = near_pairs(queries, corpus, query, key, cap).groupBy("q").agg(F.min("d").alias("d"))
    q = queries.select(F.col(query).alias("q")).distinct()
    return q.join(best, "q", "left").select(F.col("q").alias(query), F.coalesce("d", F.lit(cap + 1)).alias("distance"))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_max(df: DataFrame, group: list[str], score: str, *ties) -> DataFrame:
    """The best row of each group; ties by the given columns."""
    pack = F.struct(*[F.col(c) for c in df.columns])
    if not ties:
        return df.groupBy(*group).agg(F.max_by(pack, score).alias("_b")).select("_b.*")
    key = F.struct(F.col(score), *ties)
    return df.groupBy(*group).agg(F.max_by(pack, key).alias("_b")).select("_b.*")


def tag_union(**frames: DataFrame) -> DataFrame:
    """Frames of the same columns under each other, tagged by name."""
    return reduce(lambda a, b: a.unionByName(b), (df.withColumn("tag", F.lit(name)) for name, df in frames.items()))


def shared_tokens(df: DataFrame, group: str, tokens: str) -> DataFrame:
    """Tokens that all rows of a group have, by counts rather than by collecting sets."""
    rows = df.groupBy(group).agg(F.count("*").alias("_n"))
    each = df.select(group, F.explode(F.array_distinct(tokens)).alias("token")).groupBy(group, "token").agg(F.count("*").alias("_k"))
    return each.join(rows, group).filter("_k = _n").select(group, "token")

"""Lemmas of unknown words from a (token, lemma) table: edit rules in a trie of suffixes.

A pair of the table gives an edit, what to take off the end of the token and what to put there, under every suffix of the token that
covers what is taken off.  An unknown token takes the commonest edit of the longest suffix that any known token shares with it.  Rules are counts joined on
distinct tokens, so a text of any length costs its distinct words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectiva.sources.stages import written

#: Characters of the longest suffix in the trie.
LONGEST = 6


def _suffixes(token: Column, least: Column, longest: int) -> Column:
    """(n, suffix) for lengths from ``least`` to ``longest`` or the token's length."""
    top = F.least(F.length(token), F.lit(longest))
    each = F.transform(F.sequence(least, top), lambda n: F.struct(n.alias("n"), token.substr(F.length(token) - n + 1, n).alias("suffix")))
    return F.when(least <= top, each).otherwise(F.array().cast("array<struct<n:int,suffix:string>>"))


def suffix_rules(lemmas: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(suffix, strip, add): the commonest edit under each suffix; ties go to the first by what is taken off, then by what is added.

    A token with several lemmas counts for each; nulls are left out.
    """
    pairs = lemmas.select("token", "lemma").filter("token is not null and lemma is not null").distinct()
    both = F.least(F.length("token"), F.length("lemma"))
    same = F.when(both > 0, F.size(F.filter(F.sequence(F.lit(1), both), lambda i: F.col("token").substr(F.lit(1), i) == F.col("lemma").substr(F.lit(1), i)))).otherwise(0)
    edits = pairs.withColumn("p", same).select("token", F.expr("substring(token, p + 1)").alias("strip"), F.expr("substring(lemma, p + 1)").alias("add"))
    under = edits.select("strip", "add", F.explode(_suffixes(F.col("token"), F.length("strip"), longest)).alias("s")).groupBy("s.suffix", "strip", "add").agg(F.count("*").alias("n"))
    return under.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("n"), "strip", "add")).alias("x")).select("suffix", "x.strip", "x.add")


def guess_lemmas(tokens: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(token, lemma) of distinct tokens by the rule of their longest suffix; a token that no rule fits, or that a rule would leave empty, stays."""
    asked = tokens.select("token").filter("token is not null").distinct()
    each = asked.select("token", F.explode(_suffixes(F.col("token"), F.lit(0), longest)).alias("s")).select("token", "s.n", "s.suffix")
    best = each.join(rules, "suffix").groupBy("token").agg(F.max_by(F.struct("strip", "add"), "n").alias("x"))
    made = F.concat(F.expr("substring(token, 1, length(token) - length(x.strip))"), F.col("x.add"))
    return asked.join(best, "token", "left").select("token", F.when(F.coalesce(F.length(made), F.lit(0)) > 0, made).otherwise(F.col("token")).alias("lemma"))


def lemma_table(tokens: DataFrame, lemmas: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(token, lemma) of every distinct token: the table's, the first by name if it has several, else a guess."""
    known = lemmas.filter("token is not null and lemma is not null").groupBy("token").agg(F.min("lemma").alias("lemma"))
    asked = tokens.select("token").distinct()
    unknown = asked.join(known, "token", "left_anti")
    return asked.join(known, "token").select("token", "lemma").unionByName(guess_lemmas(unknown, written(suffix_rules(lemmas, longest), "rules"), longest))


def own_lemmas(df: DataFrame, text: str, words: Column, lemmas: DataFrame, out: str) -> DataFrame:
    """``df`` with a map from each text's words to their lemmas, known or guessed; each distinct text is split once.

    ``words`` is an array built from the column ``text``; the map goes to ``lemma_map``.
    """
    digest = F.md5(F.col(text).cast("string"))
    each = written(df.select(text).distinct().select(digest.alias("_d"), F.explode(F.array_distinct(words)).alias("token")), "words")
    found = each.join(lemma_table(each, lemmas), "token").groupBy("_d").agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias(out))
    return df.join(found, digest.eqNullSafe(F.col("_d")), "left").drop("_d")

"""Recovery of masked titles by matching lines that other rows hold in clean form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectiva.functions.text import mask_cyrillic, split_words, strip, text, title_words
from sectiva.functions.titles import parse_title
from sectiva.operators.relational import near_pairs


def line_index(titles: DataFrame, key: str, title: str) -> DataFrame:
    """(masked, clean, n_sources, source): each clean line under its masked form.

    ``source`` is the only row that attests a line, null where several do.
    """
    lines = titles.select(F.col(key).alias("source"), F.explode(F.split(text(F.col(title)), "\n", -1)).alias("raw")).select("source", strip(F.col("raw")).alias("clean")).filter("clean <> ''").distinct()
    got = lines.groupBy(mask_cyrillic(F.col("clean")).alias("masked"), "clean").agg(F.count("*").alias("n_sources"), F.min("source").alias("source"))
    return got.withColumn("source", F.when(F.col("n_sources") == 1, F.col("source")))


def decoder(key: str, title: str, **frames: DataFrame) -> DataFrame:
    """``line_index`` over several tables; a source is the table's name and the row's key, so equal keys of two tables stay apart."""
    tagged = [f.select(F.concat_ws(":", F.lit(name), F.col(key).cast("string")).alias("source_key"), F.col(title).alias("title")) for name, f in frames.items()]
    return line_index(reduce(lambda a, b: a.unionByName(b), tagged), "source_key", "title")


def provenance(lines: DataFrame, attested: DataFrame, key: str, line: str, origin: str) -> DataFrame:
    """(key, same_origin, other_origin): whether some line of a row is attested by rows of its own origin, or of another one.

    ``lines`` and ``attested`` hold (key, line, origin), a key in one origin; a row's own lines attest
    nothing for it.  Rows are counted by line and origin, so a line that many share makes no pairs.
    """
    a = attested.select(F.col(key).alias("_k"), F.col(line).alias("_l"), F.col(origin).alias("_o")).distinct()
    per = a.groupBy("_l", "_o").agg(F.count_distinct("_k").alias("_n"))
    total = a.groupBy(F.col("_l").alias("_t")).agg(F.count_distinct("_k").alias("_all"))
    own = a.select(F.col("_k").alias("_own"), F.col("_l").alias("_own_l")).distinct()
    d = lines.select(key, line, origin).distinct()
    d = d.join(per, (F.col(line) == F.col("_l")) & F.col(origin).eqNullSafe(F.col("_o")), "left").join(total, F.col(line) == F.col("_t"), "left")
    d = d.join(own, (F.col(key) == F.col("_own")) & (F.col(line) == F.col("_own_l")), "left")
    n = F.coalesce("_n", F.lit(0))
    return d.groupBy(key).agg(F.bool_or(n > F.when(F.col("_own").isNull(), 0).otherwise(1)).alias("same_origin"), F.bool_or(F.coalesce("_all", F.lit(0)) > n).alias("other_origin"))


def resolve(candidates: Column) -> Column:
    """STRUCT<text, ambiguous> of an array of clean lines: the only one; else the words that all share, in order of the first; else nothing."""
    ordered = F.array_sort(candidates)
    sets = F.transform(ordered, title_words)
    shared = F.aggregate(sets, F.get(sets, F.lit(0)), lambda a, x: F.array_intersect(a, x))
    certain = F.filter(F.get(sets, F.lit(0)), lambda w: F.array_contains(shared, w))
    n = F.size(candidates)
    return F.struct(F.when(n == 1, F.get(ordered, F.lit(0))).when(n > 1, F.array_join(certain, " ")).otherwise("").alias("text"), (n > 1).alias("ambiguous"))


def decode_lines(queries: DataFrame, index: DataFrame, key: str, masked: str, exclude_self: bool = True) -> DataFrame:
    """(key, masked, n_candidates, text, ambiguous) of masked lines; a row's own line attests nothing for itself."""
    q = queries.select(F.col(key).alias("_key"), F.col(masked).alias("masked"))
    hit = q.join(index, "masked", "left")
    if exclude_self:
        own = F.coalesce(F.col("source") == F.col("_key"), F.lit(False))
        hit = hit.withColumn("clean", F.when(~own, F.col("clean")))
    got = hit.groupBy("_key", "masked").agg(F.collect_set("clean").alias("c"))
    return got.select(F.col("_key").alias(key), "masked", F.size("c").alias("n_candidates"), resolve(F.col("c")).alias("r")).select(key, "masked", "n_candidates", "r.text", "r.ambiguous")


def decode_titles(titles: DataFrame, index: DataFrame, key: str, title: str, exclude_self: bool = True) -> DataFrame:
    """(key, guideline, age_category, hierarchy, body, coverage, text): titles decoded line by line.

    Coverage is the share of non-empty lines with exactly one candidate.
    """
    lines = titles.select(F.col(key), F.posexplode(F.split(mask_cyrillic(F.col(title)), "\n", -1)).alias("pos", "raw")).withColumn("masked", strip(F.col("raw")))
    solved = decode_lines(lines.filter("masked <> ''").select(key, "masked").distinct(), index, key, "masked", exclude_self)
    all_ = lines.join(solved, [key, "masked"], "left")
    packed = all_.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))).alias("l"), F.avg(F.when(F.col("masked") != "", (F.col("n_candidates") == 1).cast("int"))).alias("coverage"))
    whole = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    p = parse_title(whole)
    return packed.select(key, p["guideline"].alias("guideline"), p["age_category"].alias("age_category"), p["hierarchy"].alias("hierarchy"), p["body"].alias("body"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.array_join(F.array_remove(F.transform("l", lambda x: x["t"]), ""), " ").alias("text"))


def decode_audit(decoded: DataFrame) -> DataFrame:
    """Lines by number of candidates: 0, 1, 2-3, 4+."""
    n = F.col("n_candidates")
    return decoded.groupBy(F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+").alias("candidates")).agg(F.count("*").alias("n"))


def decode_quality(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """Exact matches, Jaccard similarity and recall of words of decoded lines, averaged."""
    a, b = split_words(F.lower(F.col(truth))), split_words(F.lower(F.col(guess)))
    shared = F.size(F.array_intersect(a, b))
    return pairs.agg(F.avg((F.col(truth) == F.col(guess)).cast("int")).alias("exact"), F.avg(F.try_divide(shared, F.size(F.array_union(a, b)))).alias("jaccard"), F.avg(F.try_divide(shared, F.size(F.array_distinct(a)))).alias("recall"))


def fuzzy_simulation(lines: DataFrame, masked: str, clean: str, cap: int = 6) -> DataFrame:
    """(distance, n, jaccard, recall, exact): how well lines without another exact match would be read from the nearest masked line.

    ``lines`` are distinct (masked, clean) lines.  A line's own text never counts: its candidates are the other texts of the masked
    lines nearest to it; of those the one that shares most words is taken (ties: the first by text).  Lines with another text under the same mask are left out, and so are lines
    with nothing within ``cap`` edits.
    """
    known = lines.select(F.col(masked).alias("m"), F.col(clean).alias("c")).distinct()
    sizes = known.groupBy("m").agg(F.count("*").alias("texts"))
    alone = known.join(sizes.filter("texts = 1").select("m"), "m")
    pairs = near_pairs(alone, known, "m", "m", cap).filter("q <> k")
    least = pairs.groupBy("q").agg(F.min("d").alias("least"))
    nearest = pairs.join(least, "q").filter("d = least").select(F.col("q").alias("m"), F.col("k"), "d")
    words = lambda c: F.array_distinct(split_words(F.lower(c)))
    found = alone.join(nearest, "m").join(known.select(F.col("m").alias("k"), F.col("c").alias("other")), "k")
    found = found.withColumns({"shared": F.size(F.array_intersect(words(F.col("c")), words(F.col("other")))), "either": F.size(F.array_union(words(F.col("c")), words(F.col("other")))), "own": F.size(words(F.col("c")))})
    best = found.groupBy("m", "c", "d").agg(F.min(F.struct((-F.col("shared")).alias("s"), "other", "either", "own")).alias("x"))
    shared = -F.col("x.s")
    return best.groupBy(F.col("d").alias("distance")).agg(F.count("*").alias("n"), F.avg(shared / F.greatest("x.either", F.lit(1))).alias("jaccard"), F.avg(shared / F.greatest("x.own", F.lit(1))).alias("recall"), F.avg((shared == F.col("x.either")).cast("int")).alias("exact"))

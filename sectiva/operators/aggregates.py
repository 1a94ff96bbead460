"""Label distributions, cross tables, quantiles, information, drift, lift and agreement tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectiva.operators.quantiles import quantiles
from sectiva.sources.stages import written


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("_t"))).select(column, "n", (F.col("n") / F.col("_t")).alias("share"))


def crosstab(df: DataFrame, row: str, column: str, values: list, shares: bool = False) -> DataFrame:
    """Counts of ``column`` values by ``row``, or shares of each row with its total ``n``."""
    names = [f"{column}_{v}" for v in values]
    cells = [F.count_if(F.col(column) == v).alias(c) for v, c in zip(values, names, strict=True)]
    out = df.groupBy(row).agg(*cells, F.count("*").alias("n"))
    return out.select(row, *((F.col(c) / F.col("n")).alias(c) for c in names), "n") if shares else out


def describe(df: DataFrame, column: str, percentiles=(0.5, 0.9)) -> DataFrame:
    """Count, mean, sample deviation, least, exact percentiles and most."""
    c, names = F.col(column), [f"p{round(100 * p)}" for p in percentiles]
    whole = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("least"), F.max(c).alias("most"))
    found = quantiles(df, column, list(percentiles)).select(*(F.col(f"q{i}").alias(n) for i, n in enumerate(names)))
    return whole.crossJoin(found).select("n", "mean", "sd", "least", *names, "most")


def group_rates(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))


def pure_share(df: DataFrame, key: str, label: str) -> DataFrame:
    """Share of groups whose labels all agree."""
    return df.groupBy(key).agg((F.min(label) == F.max(label)).alias("pure")).agg(F.avg(F.col("pure").cast("int")).alias("pure_share"), F.count("*").alias("groups"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """One row: rows, distinct keys and rows beyond the first of a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(F.col("n") - 1).alias("n_duplicates"))


def error_rates(df: DataFrame, by: list[str], label: str, pred: str) -> DataFrame:
    """False negatives, false positives and positive rate."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.avg(p.cast("int")).alias("positive_rate"))


def states_table(df: DataFrame, states: dict[str, Column], label: str) -> DataFrame:
    """Rows and label rate under each named predicate; predicates may overlap.  One pass, no row is repeated."""
    aggs = [x for i, c in enumerate(states.values()) for x in (F.count_if(c).alias(f"n{i}"), F.avg(F.when(c, F.col(label))).alias(f"r{i}"))]
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("state"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("rate")) for i, name in enumerate(states))))
    return df.agg(*aggs).select(rows.alias("x")).select("x.*")


def flag_lift(df: DataFrame, flags: list[str], wrong: Column) -> DataFrame:
    """Rate of each flag among wrong and right rows, and their ratio."""
    aggs = [x for i, f in enumerate(flags) for x in (F.avg(F.when(wrong, F.col(f))).alias(f"w{i}"), F.avg(F.when(~wrong, F.col(f))).alias(f"c{i}"))]
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f"w{i}").alias("wrong_rate"), F.col(f"c{i}").alias("right_rate"), F.try_divide(F.col(f"w{i}"), F.col(f"c{i}")).alias("lift")) for i, f in enumerate(flags))))
    return df.agg(*aggs).select(rows.alias("x")).select("x.*")


def category_table(df: DataFrame, category: str, value: str) -> DataFrame:
    """Count, share, median, p10, p90 and mean of a value by category."""
    t = df.groupBy(category).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    found = quantiles(df, value, [0.5, 0.1, 0.9], [category]).select(F.col(category).alias("_g"), F.col("q0").alias("median"), F.col("q1").alias("p10"), F.col("q2").alias("p90"))
    t = t.join(found, F.col(category).eqNullSafe(F.col("_g")), "left")
    return t.crossJoin(t.agg(F.sum("n").alias("_t"))).select(category, "n", (F.col("n") / F.col("_t")).alias("share"), "median", "p10", "p90", "mean")


def all_missed(df: DataFrame, key: str, label: str, pred: str) -> DataFrame:
    """Groups with positives all of which are missed."""
    got = df.filter(F.col(label) == 1).groupBy(key).agg(F.count("*").alias("positives"), F.bool_and(F.col(pred) == 0).alias("_m"))
    return got.filter("_m").select(key, "positives")


def between_share(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of a value's variance that lies between groups, from group sums alone."""
    g = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    total = g.agg(F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("w"))
    between = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    return total.select(F.try_divide(between, between + F.col("w") / F.col("n")).alias("between_share"))


def group_correlation(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(a).alias("a"), F.avg(b).alias("b")).agg(F.corr("a", "b").alias("r"))


def _entropy(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(total).agg((-F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("t")))).alias("h"))


def mutual_information(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Bits that the keys jointly give about a label, from counts."""
    joint = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    parts = [_entropy(x).withColumnRenamed("h", c) for x, c in ((joint.groupBy(*keys).agg(F.sum("n").alias("n")), "hx"), (joint.groupBy(label).agg(F.sum("n").alias("n")), "hy"), (joint, "hxy"))]
    return reduce(lambda a, b: a.crossJoin(b), parts).select((F.col("hx") + F.col("hy") - F.col("hxy")).alias("bits"))


def synergy(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """Bits of two features together beyond those of each."""
    each = [mutual_information(df, k, label).withColumnRenamed("bits", n) for k, n in (([a, b], "ab"), ([a], "a"), ([b], "b"))]
    return reduce(lambda x, y: x.crossJoin(y), each).select((F.col("ab") - F.col("a") - F.col("b")).alias("synergy"), "ab", "a", "b")


def synergies(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(a, b, synergy) for every pair of columns; rows are read once, all pairs are taken from their joint counts."""
    joint = written(df.groupBy(*columns, label).agg(F.count("*").alias("_n")), "joint")
    sets = [(c,) for c in columns] + list(combinations(columns, 2))

    def bits(keys):
        per = joint.groupBy(*keys, label).agg(F.sum("_n").alias("n"))
        parts = (per.groupBy(*keys).agg(F.sum("n").alias("n")), per.groupBy(label).agg(F.sum("n").alias("n")), per)
        return [_entropy(x).select(F.lit("|".join(keys)).alias("k"), (F.col("h") * s).alias("bits")) for x, s in zip(parts, (1, 1, -1), strict=True)]

    each = reduce(lambda x, y: x.unionByName(y), (p for k in sets for p in bits(k))).groupBy("k").agg(F.sum("bits").alias("bits"))
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(f"{a}|{b}").alias("ab")) for a, b in combinations(columns, 2))))
    named = lambda c: each.select(F.col("k").alias(c), F.col("bits").alias(f"{c}_bits"))
    rows = each.limit(1).select(pairs.alias("x")).select("x.*").join(named("a"), "a").join(named("b"), "b").join(named("ab"), "ab")
    return rows.select("a", "b", (F.col("ab_bits") - F.col("a_bits") - F.col("b_bits")).alias("synergy"))


def varied(df: DataFrame, by: str, value: str, min_rows: int = 2, min_values: int = 2) -> DataFrame:
    """(by, n, n_values): groups of at least so many rows and distinct values; a text to group by is shuffled as its digest, and once for each group."""
    key = F.sha2(F.col(by), 256) if dict(df.dtypes)[by] == "string" else F.col(by)
    got = df.groupBy(key.alias("_key")).agg(F.first(by).alias(by), F.count("*").alias("n"), F.count_distinct(value).alias("n_values"))
    return got.filter((F.col("n") >= min_rows) & (F.col("n_values") >= min_values)).select(by, "n", "n_values")


def error_lift(df: DataFrame, flags: list[str], label: str, pred: str) -> DataFrame:
    """(flag, kind, rate, right_rate, lift): rate of each flag among false negatives and false positives against right rows."""
    y, p = F.col(label), F.col(pred)
    kinds = {"fn": (y == 1) & (p == 0), "fp": (y == 0) & (p == 1), "right": y == p}
    aggs = [F.avg(F.when(c, F.col(f))).alias(f"{k}{i}") for i, f in enumerate(flags) for k, c in kinds.items()]
    rows = [F.struct(F.lit(f).alias("flag"), F.lit(k).alias("kind"), F.col(f"{k}{i}").alias("rate"), F.col(f"right{i}").alias("right_rate"), F.try_divide(F.col(f"{k}{i}"), F.col(f"right{i}")).alias("lift")) for i, f in enumerate(flags) for k in ("fn", "fp")]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def coverage_by_role(df: DataFrame, role: str, value: str) -> DataFrame:
    """(role, n, coverage, gap): mean of a value by role, and the widest gap between roles."""
    per = df.groupBy(role).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("coverage"))
    return per.crossJoin(F.broadcast(per.agg((F.max("coverage") - F.min("coverage")).alias("gap"))))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins of [0, 1], the last one closed."""
    return df.select(F.least(F.width_bucket(F.col(column), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("weighted_mean"))


def mean_spread(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd0"), F.stddev_samp(value).alias("sd1"))


def common_values(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def count_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur once, twice and so on."""
    return df.groupBy(key).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("keys"))


def drift(df: DataFrame, split: str, columns: list[str]) -> DataFrame:
    """Standardised mean difference of each column between two values (0, 1) of ``split``; a zero spread counts as 1."""
    pick = lambda c, v: F.when(F.col(split) == v, F.col(c))
    aggs = [f(pick(c, v)).alias(f"{c}_{n}{v}") for c in columns for v in (0, 1) for f, n in ((F.avg, "m"), (F.var_pop, "v"))]
    sd = lambda c: F.sqrt((F.col(f"{c}_v0") + F.col(f"{c}_v1")) / 2)
    row = lambda c: F.struct(F.lit(c).alias("feature"), (F.abs(F.col(f"{c}_m0") - F.col(f"{c}_m1")) / F.when(sd(c) == 0, F.lit(1.0)).otherwise(sd(c))).alias("smd"))
    return df.agg(*aggs).select(F.explode(F.array(*map(row, columns))).alias("x")).select("x.*")


def coverage_gap(df: DataFrame, split: str, flags: list[str]) -> DataFrame:
    """Rate of each flag on both sides of a 0/1 split, and the gap."""
    aggs = [F.avg(F.when(F.col(split) == v, F.col(f))).alias(f"{f}_{v}") for f in flags for v in (0, 1)]
    row = lambda f: F.struct(F.lit(f).alias("flag"), F.col(f"{f}_0").alias("rate_0"), F.col(f"{f}_1").alias("rate_1"), F.abs(F.col(f"{f}_0") - F.col(f"{f}_1")).alias("gap"))
    return df.agg(*aggs).select(F.explode(F.array(*map(row, flags))).alias("x")).select("x.*")


def vocabulary_transfer(tokens: DataFrame, split: str, key: str, token: str) -> DataFrame:
    """One row: how much of the vocabulary and of the tokens of side 1 side 0 knows, and rows of side 1 that it knows nothing of."""
    per = written(tokens.groupBy(F.col(token).alias("_t")).agg(F.count_if(F.col(split) == 0).alias("n0"), F.count_if(F.col(split) == 1).alias("n1")), "vocabulary")
    known, there = F.col("n0") > 0, per.filter("n1 > 0")
    vocab = there.agg(F.avg(known.cast("int")).alias("vocabulary_coverage"), (F.sum(F.when(known, F.col("n1")).otherwise(0)) / F.sum("n1")).alias("token_coverage"))
    rows = tokens.filter(F.col(split) == 1).select(F.col(key).alias("_r"), F.col(token).alias("_w")).join(per.filter("n0 > 0 and n1 > 0").select("_t"), F.col("_w") == F.col("_t"), "left")
    zero = rows.groupBy("_r").agg(F.count("_t").alias("k")).agg(F.count_if(F.col("k") == 0).alias("zero_rows"), F.avg("k").alias("active_per_row"))
    return vocab.crossJoin(zero)


def marked_mass(weights: DataFrame, rows: DataFrame, key: str, split: str, marked: Column) -> DataFrame:
    """(split, mass, active, zero_rows, n): share of the weight on marked terms, known terms per row, rows without any, by side.

    ``weights`` is (key, term, weight); rows without weights count.
    """
    per = weights.groupBy(F.col(key).alias("_k")).agg(F.sum("weight").alias("_w"), F.sum(F.when(marked, F.col("weight")).otherwise(0.0)).alias("_m"), F.count("*").alias("_n"))
    d = rows.select(key, split).join(per, F.col(key).eqNullSafe(F.col("_k")), "left")
    return d.groupBy(split).agg(F.try_divide(F.sum("_m"), F.sum("_w")).alias("mass"), F.avg(F.coalesce("_n", F.lit(0))).alias("active"), F.count_if(F.col("_n").isNull()).alias("zero_rows"), F.count("*").alias("n"))


def integrity(df: DataFrame, key: str, required: list[str], label: str | None = None) -> DataFrame:
    """One row of checks: rows, nulls, distinct keys, whether labels are 0 or 1."""
    checks = [F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.sum(sum((F.col(c).isNull().cast("int") for c in required[1:]), F.col(required[0]).isNull().cast("int"))).alias("n_nulls")]
    if label:
        checks.append(F.bool_and(F.col(label).isin(0, 1)).alias("labels_binary"))
    return df.agg(*checks)


def quantile_bins(df: DataFrame, column: str, q: int = 4, out: str = "bin") -> DataFrame:
    """Bin by exact quantile edges, equal edges merged; values on an edge fall below it."""
    edges = quantiles(df, column, [i / q for i in range(q + 1)]).select(F.array_distinct(F.array(*(F.col(f"q{i}") for i in range(q + 1)))).alias("_e"))
    spot = F.size(F.filter(F.slice(F.col("_e"), F.lit(1), F.size("_e") - 1), lambda e: F.col(column) > e))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.greatest(spot, F.lit(1))).drop("_e")


def agreement(df: DataFrame, a: str, b: str, pa: str, pb: str) -> DataFrame:
    """Share of equal predictions, of different ones, and mean gap of probabilities."""
    same = (F.col(a) == F.col(b)).cast("int")
    return df.agg(F.avg(same).alias("agree"), F.avg(1 - same).alias("disagree"), F.avg(F.abs(F.col(pa) - F.col(pb))).alias("mean_gap"))


def fold_composition(df: DataFrame, fold: str, label: str, group: str, coverage: str | None = None) -> DataFrame:
    """Per fold: rows, label rate, share of rows whose group other folds have, too, and the mean of a coverage column if one is named."""
    spread = df.groupBy(group).agg(F.min(fold).alias("_lo"), F.max(fold).alias("_hi"))
    seen = df.join(spread, group).withColumn("_s", (F.col("_lo") < F.col("_hi")).cast("int"))
    more = [F.avg(coverage).alias("coverage")] if coverage else []
    return seen.groupBy(fold).agg(F.count("*").alias("n"), F.avg(label).alias("rate"), F.avg("_s").alias("seen_group_share"), *more)


def group_mean(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` with the mean of a value over each row's group, its rows added up in one place and in one order; ``joined_mean`` splits hot groups."""
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(key)))


def joined_mean(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``group_mean`` from partial sums joined back, so that no task gathers a frequent key; the last bits depend on how rows are dealt."""
    means = df.groupBy(F.col(key).alias("_k")).agg(F.avg(value).alias(out))
    return df.join(means, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def recurrence(df: DataFrame, key: str, out: str = "times") -> DataFrame:
    """How often a row's key occurs: counts joined back, so a frequent key isn't gathered in one task."""
    counts = df.groupBy(key).agg(F.count("*").alias(out))
    return df.join(counts.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def feature_checks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature: distinct values and whether it is constant."""
    aggs = df.agg(*(F.count_distinct(c).alias(c) for c in columns))
    row = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_distinct"), (F.col(c) <= 1).alias("constant"))
    return aggs.select(F.explode(F.array(*map(row, columns))).alias("x")).select("x.*")


def duplicate_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, same_as): columns that equal an earlier one in every row, nulls included, with the first that they equal; one pass."""
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[:i]]
    got = df.agg(*(F.coalesce(F.bool_and(F.col(a).eqNullSafe(F.col(b))), F.lit(False)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)), F.count("*").alias("_n"))
    rows = F.filter(F.array(*(F.when(F.col(f"s{i}"), F.struct(F.lit(b).alias("feature"), F.lit(a).alias("same_as"), F.lit(columns.index(a)).alias("i"))) for i, (a, b) in enumerate(pairs))), lambda x: x.isNotNull())
    return got.select(F.explode(rows).alias("x")).groupBy("x.feature").agg(F.min_by("x.same_as", "x.i").alias("same_as"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return got.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")

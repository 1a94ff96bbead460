"""Exact classification metrics from counts: macro F-beta scores, AUC, threshold sweeps, decompositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectiva.operators.ordered import ranged, running
from sectiva.operators.quantiles import quantiles

# The floor and the range of both scores, the share of each in the total.
FLOOR, RANGE = 0.5, 0.45
TOTAL, WEIGHT_1, WEIGHT_2 = 70.0, 0.3, 0.7


def counts(label: Column, pred: Column) -> list[Column]:
    """tp, fp, fn, tn."""
    return [F.count_if((label == y) & (pred == p)).alias(n) for n, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    """F-beta of one class; 0 where nothing is there or predicted."""
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * tp, (1 + b) * tp + b * fn + fp), F.lit(0.0))


def macro_f_beta(beta: float, tp="tp", fp="fp", fn="fn", tn="tn") -> Column:
    tp, fp, fn, tn = map(F.col, (tp, fp, fn, tn))
    return (f_beta(tp, fp, fn, beta) + f_beta(tn, fn, fp, beta)) / 2


def rescaled(macro: Column) -> Column:
    """A macro score on the scale from the trivial 0.5 to 0.95, clipped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (macro - FLOOR) / RANGE))


def m1() -> Column:
    """Stage-one score of a row of counts: macro F0.5, rescaled."""
    return rescaled(macro_f_beta(0.5))


def m2() -> Column:
    """Stage-two score of a row of counts: macro F2, rescaled."""
    return rescaled(macro_f_beta(2.0))


def total_score(m_1: Column, m_2: Column) -> Column:
    return TOTAL * (WEIGHT_1 * m_1 + WEIGHT_2 * m_2)


def scores(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Counts, macro F-beta and rescaled scores, per group."""
    got = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *counts(F.col(label), F.col(pred)))
    return got.withColumns({"macro_f05": macro_f_beta(0.5), "macro_f2": macro_f_beta(2.0), "m1": m1(), "m2": m2()})


def subgroup_scores(df: DataFrame, label: str, pred: str, value: str, optional: list[str], q: int = 4) -> DataFrame:
    """``scores`` of overlapping subgroups: quantile bins of a value (``value:1`` and so on), and rows that lack a field or have it (``field:missing``, ``field:present``).

    A row counts in each of its subgroups; sums are taken before anything is shuffled.  A null value is in no bin.
    """
    edges = quantiles(df, value, [i / q for i in range(1, q)]).select(F.array(*(F.col(f"q{i}") for i in range(q - 1))).alias("_e"))
    binned = df.crossJoin(F.broadcast(edges))
    over = 1 + F.size(F.filter("_e", lambda e: F.col(value) > e))
    names = [F.when(F.col(value).isNotNull(), F.concat(F.lit(f"{value}:"), over.cast("string")))]
    names += [F.concat(F.lit(f"{c}:"), F.when(F.col(c).isNull(), "missing").otherwise("present")) for c in optional]
    each = binned.select(label, pred, F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())).alias("subgroup"))
    return scores(each, label, pred, ["subgroup"])


def class_report(df: DataFrame, label: str, pred: str, beta: float = 1.0) -> DataFrame:
    """Precision, recall, F and support of both classes."""
    got = df.agg(*counts(F.col(label), F.col(pred)))
    c = F.col
    row = lambda k, tp, fp, fn: F.struct(F.lit(k).alias("class"), F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"), f_beta(tp, fp, fn, beta).alias("f"), (tp + fn).alias("support"))
    return got.select(F.explode(F.array(row(0, c("tn"), c("fn"), c("fp")), row(1, c("tp"), c("fp"), c("fn")))).alias("x")).select("x.*")


def auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties averaged; null where a group has one class only.

    Scores are counted first, so what is ordered are distinct scores; they are dealt to ranges, whatever the group, and each
    range adds up its own (``ordered``).
    """
    by = by or []
    y = F.col(label)
    per = df.groupBy(*by, score).agg(F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_q"))
    upto = running(ranged(per, *by, score), [score], {"_upto": F.col("_q")}, by)
    area = upto.withColumn("_a", F.col("_p") * (F.col("_upto") - F.col("_q") / 2))
    return area.groupBy(*by).agg(F.try_divide(F.sum("_a"), F.sum("_p").cast("double") * F.sum("_q")).alias("auc"), (F.sum("_p") + F.sum("_q")).alias("n"))


def weighted_auc(df: DataFrame, label: str, score: str, by: str) -> DataFrame:
    """Mean, median and size-weighted AUC over groups with both classes, how many are below chance, how many are left out."""
    per = auc(df, label, score, [by])
    found = per.agg(
        F.avg("auc").alias("mean"), F.try_divide(F.sum(F.col("auc") * F.col("n")), F.sum(F.when(F.col("auc").isNotNull(), F.col("n")))).alias("weighted"),
        F.count_if(F.col("auc") < 0.5).alias("below_half"), F.count_if(F.col("auc").isNull()).alias("one_class"),
    )
    return found.crossJoin(quantiles(per, "auc", [0.5]).select(F.col("q0").alias("median"))).select("mean", "median", "weighted", "below_half", "one_class")


def grid(lo: float = 0.05, hi: float = 0.95, step: float = 0.01) -> list[float]:
    n = round((hi - lo) / step)
    return [round(lo + i * step, 10) for i in range(n + 1)]


def sweep(df: DataFrame, label: str, score: str, thresholds: list[float] | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts and scores at every threshold of a grid, per group.

    Each row is counted once, in the slot of the highest threshold it reaches; sums from above give
    the counts at each threshold, so rows aren't crossed with the grid.
    """
    ts, by = thresholds or grid(), by or []
    edges = F.array(*map(F.lit, ts))
    slot = F.size(F.filter(edges, lambda t: F.col(score) >= t))
    y = F.col(label)
    per = df.groupBy(*by, slot.alias("slot")).agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("q"))
    packed = per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("p", "q")))).alias("m"), F.sum("p").alias("pp"), F.sum("q").alias("qq"))
    above = lambda i, k: F.aggregate(F.map_values(F.map_filter("m", lambda s, _: s >= i)), F.lit(0).cast("long"), lambda a, v: a + v[k])
    rows = packed.select(*by, "m", "pp", "qq", F.posexplode(edges).alias("i", "threshold"))
    rows = rows.withColumns({"tp": above(F.col("i") + 1, "p"), "fp": above(F.col("i") + 1, "q")})
    rows = rows.withColumns({"fn": F.col("pp") - F.col("tp"), "tn": F.col("qq") - F.col("fp")})
    return rows.select(*by, "threshold", "tp", "fp", "fn", "tn", m1().alias("m1"), m2().alias("m2"), ((F.col("tp") + F.col("fp")) / (F.col("pp") + F.col("qq"))).alias("positive_rate"))


def best_threshold(swept: DataFrame, metric: str = "m2", by: list[str] | None = None, near: float = 0.5) -> DataFrame:
    """The threshold of the highest score; ties go to the one nearest to ``near``, then to the lower."""
    key = F.struct(F.round(metric, 12), -F.round(F.abs(F.col("threshold") - near), 12), -F.col("threshold"))
    return swept.groupBy(*(by or [])).agg(F.max_by("threshold", key).alias("threshold"), F.max(metric).alias(metric))


def first_best(swept: DataFrame, metric: str = "m2", by: list[str] | None = None) -> DataFrame:
    """The lowest threshold that reaches the highest score."""
    return swept.groupBy(*(by or [])).agg(F.max_by("threshold", F.struct(F.col(metric), -F.col("threshold"))).alias("threshold"), F.max(metric).alias(metric))


def plateau(swept: DataFrame, metric: str = "m2", within: float = 0.005) -> DataFrame:
    """Thresholds whose score is near the best: lowest, highest and number."""
    best = swept.agg(F.max(metric).alias("_b"))
    return swept.crossJoin(best).filter(F.col(metric) >= F.col("_b") - within).agg(F.min("threshold").alias("lowest"), F.max("threshold").alias("highest"), F.count("*").alias("n"))


def rate_cut(df: DataFrame, score: str, k: int) -> DataFrame:
    """0/1 predictions that keep the ``k`` highest scores, ties with the last one kept."""
    cut = df.select(score).orderBy(F.desc(score)).limit(k).agg(F.min(score).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("pred", F.coalesce((F.col(score) >= F.col("_cut")).cast("int"), F.lit(0))).drop("_cut")


def matching_threshold(df: DataFrame, score: str, shipped: str, thresholds: list[float] | None = None) -> DataFrame:
    """The threshold whose predictions agree most with shipped labels, and the rows that still differ."""
    swept = sweep(df, shipped, score, thresholds)
    return best_threshold(swept.withColumn("equal", F.col("tp") + F.col("tn")).withColumn("differ", F.col("fp") + F.col("fn")), "equal").join(swept.select("threshold", (F.col("fp") + F.col("fn")).alias("differ")), "threshold")


def decomposition(total_zero_1: Column, total: Column) -> dict[str, Column]:
    """Stage scores out of a total with an all-zero first stage and a total with both."""
    s2 = WEIGHT_2 * TOTAL
    return {"m2": total_zero_1 / s2, "m1": (total - total_zero_1) / (TOTAL - s2)}


def reachable(targets: DataFrame, key: str, beta: float = 2.0, positives: str = "p", negatives: str = "n", low: str = "low", high: str = "high") -> DataFrame:
    """(key, fn, fp_from, fp_to): all confusion counts whose macro F-beta lies in [low, high], for given class sizes.

    For a number of misses the score falls as false alarms rise, so those in the interval are a range, found by halving; a row is a number of
    misses, and nothing is enumerated but those.  Class sizes must not be null.
    """
    each = targets.select(F.col(key), F.col(positives).cast("bigint").alias("_p"), F.col(negatives).cast("bigint").alias("_n"), F.col(low).cast("double").alias("_low"), F.col(high).cast("double").alias("_high")).withColumn("fn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_p"))))

    def score(fp: Column) -> Column:
        tp, tn, fn, b = F.col("_p") - F.col("fn"), F.col("_n") - fp, F.col("fn"), beta * beta
        one = lambda hit, alarm, miss: F.coalesce(F.try_divide((1 + b) * hit, (1 + b) * hit + b * miss + alarm), F.lit(0.0))
        return (one(tp, fp, fn) + one(tn, fn, fp)) / 2

    def below(bound: Column, strict: bool) -> Column:
        """How many false alarms keep the score over the bound (``strict``) or at it: the least number that doesn't."""
        start = F.struct(F.lit(0).cast("bigint").alias("lo"), (F.col("_n") + 1).alias("hi"))

        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("bigint")
            kept = score(mid) > bound if strict else score(mid) >= bound
            return F.when(acc["lo"] >= acc["hi"], acc).when(kept, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.col("_n") + 2)).cast("int")), start, halve, lambda acc: acc["lo"])

    found = each.withColumns({"fp_from": below(F.col("_high"), True), "fp_to": below(F.col("_low"), False) - 1})
    return found.filter("fp_from <= fp_to").select(key, "fn", "fp_from", "fp_to")

"""Folds, out-of-fold evaluation, corrected paired tests, promotion gates, per-group offsets."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectiva.operators.metrics import auc, best_threshold, counts, m2, macro_f_beta, rescaled, sweep
from sectiva.operators.ordered import ranged, running


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: per class, rows in hash order are dealt out in turn, so sizes differ by one at most.

    Hash order is found by splitting a class into hash ranges and counting them; no task ranks a whole class.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    d = df.withColumn("_h", h).withColumn("_part", F.shiftright("_h", 54))
    sizes = d.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(label).alias("_y"), F.col("_part").alias("_p"), start.alias("_start"))
    d = d.join(F.broadcast(starts), d[label].eqNullSafe(F.col("_y")) & (d["_part"] == F.col("_p")))
    rank = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_h", key)) - 1 + F.col("_start")
    return d.withColumn("fold", F.pmod(rank, F.lit(k)).cast("int")).select(*df.columns, "fold")


def repeated_folds(df: DataFrame, key: str, label: str, seeds, k: int = 5) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), (stratified_folds(df, key, label, k, s).withColumn("seed", F.lit(s)) for s in seeds))


def deal_equal(loads: list[int], size: int, n: int) -> list[tuple[int, list[int]]]:
    """Deal ``n`` groups of one size to the lightest fold each (ties: smaller number): (first, cycle) stretches; ``loads`` are brought up to date.

    Group number r of a stretch that begins at ``first`` goes to ``cycle[(r - first) % len(cycle)]``.  The folds that take turns stay the same until
    they have caught up with another one, so there are at most as many stretches as folds.
    """
    out, done = [], 0
    while done < n:
        order = sorted(range(len(loads)), key=lambda j: (loads[j], j))
        turn = [j for j in order if (loads[j], j) < (loads[order[0]] + size, order[0])]
        rest = [(loads[j], j) for j in order if j not in turn]
        rounds = min((-(-(rest[0][0] - loads[j] + (j < rest[0][1])) // size) for j in turn), default=1) if rest else -(-(n - done) // len(turn))
        take = min(max(rounds, 1) * len(turn), n - done)
        out.append((done, turn))
        for k, j in enumerate(turn):
            loads[j] += size * (take // len(turn) + (k < take % len(turn)))
        done += take
    return out


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """``df`` with ``fold``: groups, the largest first and equal ones by name, each to the fold that has the fewest rows so far.

    The driver sees how many groups there are of each size; groups of one size are numbered in ranges, so no task ranks all
    groups.  No group is split; null is a group.
    """
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    dealt = ranged(sizes, "_n", "_g")
    loads, plan = [0] * k, []
    for r in sorted(dealt.groupBy("_n").agg(F.count("*").alias("m")).collect(), key=lambda r: -r["_n"]):
        plan.append((r["_n"], [{"first": a, "cycle": c} for a, c in deal_equal(loads, r["_n"], r.m)]))
    plans = df.sparkSession.createDataFrame(plan, "_s bigint, plan array<struct<first:bigint,cycle:array<int>>>")
    numbered = running(dealt, ["_g"], {"_r": F.lit(1)}, ["_n"]).withColumn("_r", F.col("_r") - 1)
    own = F.element_at(F.filter("plan", lambda x: x["first"] <= F.col("_r")), -1)
    folds = numbered.join(plans, F.col("_n") == F.col("_s")).withColumn("_own", own).select("_g", F.get(F.col("_own.cycle"), ((F.col("_r") - F.col("_own.first")) % F.size("_own.cycle")).cast("int")).alias("fold"))
    return df.join(folds, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], k: int = 5, fold: str = "fold") -> DataFrame:
    """Predictions of each fold by a model fitted on the others: ``fit`` takes rows and returns a function of rows."""
    return reduce(lambda a, b: a.unionByName(b), (fit(df.filter(F.col(fold) != i))(df.filter(F.col(fold) == i)) for i in range(k)))


def cross_fitted_thresholds(oof: DataFrame, label: str, score: str, k: int = 5, fold: str = "fold") -> DataFrame:
    """Per fold: the best threshold on the other folds and the score it gives on this one."""
    per = sweep(oof, label, score, by=[fold])
    others = per.select(F.col(fold).alias("_f"), "threshold", "tp", "fp", "fn", "tn")
    folds = per.select(fold).distinct()
    rest = folds.crossJoin(F.broadcast(others)).filter(F.col(fold) != F.col("_f")).groupBy(fold, "threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))).withColumn("m2", m2())
    chosen = best_threshold(rest, "m2", [fold]).select(fold, "threshold")
    return per.join(chosen, [fold, "threshold"]).select(fold, "threshold", "m2")


def fold_scores(oof: DataFrame, label: str, pred: str, by: list[str]) -> DataFrame:
    return oof.groupBy(*by).agg(F.count("*").alias("n"), *counts(F.col(label), F.col(pred))).withColumn("macro_f2", macro_f_beta(2.0)).withColumn("m2", rescaled(F.col("macro_f2")))


def paired_deltas(candidate: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """Differences of macro scores of the same folds on the rescaled range, not clipped."""
    a, b = candidate.select(*by, "n", F.col("macro_f2").alias("a")), baseline.select(*by, F.col("macro_f2").alias("b"))
    return a.join(b, by).select(*by, "n", ((F.col("a") - F.col("b")) / 0.45).alias("delta"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_upper_tail(t: float, df: float) -> float:
    """P(T > t) of Student's distribution."""
    x = df / (df + t * t)
    front = math.exp(math.lgamma(df / 2 + 0.5) - math.lgamma(df / 2) - math.lgamma(0.5) + df / 2 * math.log(x) + 0.5 * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 0.5
    p = front * _beta_fraction(df / 2, 0.5, x) / (df / 2) if x < (df / 2 + 1) / (df / 2 + 2.5) else 1 - front * _beta_fraction(0.5, df / 2, 1 - x) / 0.5
    return p / 2 if t > 0 else 1 - p / 2


def corrected_test(deltas: DataFrame, n_rows: int) -> dict[str, float]:
    """Nadeau-Bengio corrected one-sided paired t-test over repeated folds; the test size is the first fold's."""
    r = deltas.agg(F.count("*").alias("k"), F.avg("delta").alias("mean"), F.var_samp("delta").alias("var"), F.min_by("n", F.struct(*[c for c in deltas.columns if c not in ("n", "delta")])).alias("n")).first()
    scale = (r["var"] or 0.0) * (1 / r["k"] + r["n"] / (n_rows - r["n"]))
    t = r["mean"] / math.sqrt(scale) if scale > 0 else math.copysign(math.inf, r["mean"]) if r["mean"] else 0.0
    return {"mean": r["mean"], "t": t, "p": t_upper_tail(t, r["k"] - 1) if math.isfinite(t) else float(t < 0)}


def passes_gate(mean: float, p: float, repeats_won: int, repeats: int = 5, level: float = 0.10) -> bool:
    """Promotion: a gain on average, significant, in at least all but one of the repeats."""
    return mean > 0 and p < level and repeats_won >= repeats - 1


def passes_old_gate(mean: float, folds_won: int, folds: int = 5) -> bool:
    return mean > 0 and folds_won >= folds - 1


def ablation(fold_table: DataFrame, variant: str, base: str, by: list[str]) -> DataFrame:
    """Per variant: mean score, difference to the base and folds won."""
    b = fold_table.filter(F.col(variant) == base).select(*by, F.col("m2").alias("_b"))
    return fold_table.join(b, by).groupBy(variant).agg(F.avg("m2").alias("m2"), F.avg(F.col("m2") - F.col("_b")).alias("delta"), F.count_if(F.col("m2") > F.col("_b")).alias("folds_won"))


def group_offsets(train: DataFrame, group: str, score: str, shrink: float = 5.0, one_sided: bool = False) -> DataFrame:
    """(group, offset): distance of a group's mean score from the overall mean, shrunk by n / (n + shrink)."""
    g = train.groupBy(group).agg(F.count("*").alias("_n"), F.avg(score).alias("_m"))
    overall = g.agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_all"))
    offset = (F.col("_m") - F.col("_all")) * F.col("_n") / (F.col("_n") + shrink)
    return g.crossJoin(overall).select(group, (F.least(offset, F.lit(0.0)) if one_sided else offset).alias("offset"))


def apply_centering(df: DataFrame, offsets: DataFrame, group: str, score: str, strength: float = 1.0, out: str = "centred") -> DataFrame:
    """Scores less their group's offset, kept in [0, 1]; an unseen group has none."""
    d = df.join(offsets.select(F.col(group).alias("_g"), "offset"), F.col(group) == F.col("_g"), "left")
    return d.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) - strength * F.coalesce("offset", F.lit(0.0))))).drop("_g", "offset")


def cross_fitted_centering(df: DataFrame, group: str, score: str, fold: str = "fold", shrink: float = 5.0, strength: float = 1.0, out: str = "centred") -> DataFrame:
    """Scores less offsets that were learned on the other folds, from one table of sums by group and fold."""
    part = df.groupBy(F.col(group).alias("_g"), F.col(fold).alias("_f")).agg(F.count("*").alias("_n"), F.sum(score).alias("_s"))
    folds = part.groupBy("_f").agg(F.sum("_n").alias("_fn"), F.sum("_s").alias("_fs"))
    all_ = folds.agg(F.sum("_fn").alias("_an"), F.sum("_fs").alias("_as"))
    groups = part.groupBy("_g").agg(F.sum("_n").alias("_gn"), F.sum("_s").alias("_gs"))
    n, s = F.col("_gn") - F.col("_n"), F.col("_gs") - F.col("_s")
    overall = (F.col("_as") - F.col("_fs")) / (F.col("_an") - F.col("_fn"))
    offset = F.when(n > 0, (s / n - overall) * n / (n + shrink)).otherwise(0.0)
    offsets = part.join(groups, part["_g"].eqNullSafe(groups["_g"])).drop(groups["_g"]).join(F.broadcast(folds), "_f").crossJoin(F.broadcast(all_)).select("_g", "_f", offset.alias("_o"))
    d = df.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & F.col(fold).eqNullSafe(F.col("_f")))
    return d.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) - strength * F.coalesce("_o", F.lit(0.0))))).drop("_g", "_f", "_o")


def summarise(oof: DataFrame, label: str, pred: str, score: str, fold: str, group: str) -> DataFrame:
    """One row: mean and deviation of folds' scores, AUC, errors, positive rate, and groups whose predictions are all alike."""
    per = fold_scores(oof, label, pred, [fold]).agg(F.avg("m2").alias("m2_mean"), F.stddev_samp("m2").alias("m2_sd"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    alike = oof.groupBy(group).agg(F.count("*").alias("n"), F.min(pred).alias("a"), F.max(pred).alias("b"), F.sum(pred).alias("p"))
    groups = alike.agg(F.count_if((F.col("n") > 1) & (F.col("a") == F.col("b"))).alias("collapsed"), (F.sum("p") / F.sum("n")).alias("positive_rate"))
    return per.crossJoin(auc(oof, label, score).select("auc")).crossJoin(groups)


def reproduced(row: DataFrame, reference: dict[str, float], tolerance: float = 1e-6) -> DataFrame:
    """(metric, value, expected, ok): a row of results against stored ones; a missing value is not ok."""
    checks = [F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("expected"), F.coalesce(F.abs(F.col(k) - v) <= tolerance, F.lit(False)).alias("ok")) for k, v in reference.items()]
    return row.select(F.explode(F.array(*checks)).alias("x")).select("x.*")


def submission_checks(df: DataFrame, template: DataFrame, shipped: DataFrame, key: list[str], position: str, label: str, frozen: Column) -> DataFrame:
    """One row: rows against a template, rows in another place, labels that aren't 0 or 1, and changed labels where ``frozen`` holds."""
    t = template.select(*key, F.col(position).alias("_p"))
    s = shipped.select(*key, F.col(label).alias("_l"))
    d = df.withColumn("_mine", F.lit(1)).join(t, key, "full").join(s, key, "left")
    return d.agg(
        F.count("_mine").alias("n_rows"), F.count_if(F.col("_mine").isNull()).alias("missing"), F.count_if(F.col("_p").isNull()).alias("unknown"), F.count_if(F.col(position) != F.col("_p")).alias("moved"),
        F.count_if(F.col("_mine").isNotNull() & ~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("not_binary"), F.count_if(frozen & ~F.col(label).eqNullSafe(F.col("_l"))).alias("changed"),
    )


def selective_centering(df: DataFrame, offsets: DataFrame, group_auc: DataFrame, group: str, score: str, gate: float = 0.5, out: str = "centred") -> DataFrame:
    """Centring only for groups whose training AUC is at least ``gate``."""
    return apply_centering(df, offsets.join(group_auc.filter(F.col("auc") >= gate).select(group), group, "left_semi"), group, score, out=out)


def miss_category(label: Column, pred: Column, rules: list[tuple[str, Column]], other: str = "other") -> Column:
    """The first rule that holds of a missed positive; null for other rows."""
    case = F
    for name, rule in rules:
        case = case.when(rule, F.lit(name))
    return F.when((label == 1) & (pred == 0), case.otherwise(F.lit(other)))


def recurrence_encoding(train: DataFrame, rows: DataFrame, key: str, label: str, alpha: float = 10.0, leave_one_out: bool = False) -> DataFrame:
    """``rows`` with count, seen flag and smoothed target rate of a key, learned on ``train``.

    ``leave_one_out`` takes a row's own label out of its key's statistics: for rows of ``train`` itself.
    Unseen keys have count 0 and the prior.
    """
    stats = train.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.sum(label).alias("_s"))
    prior = train.agg(F.avg(label).alias("_prior"))
    d = rows.join(stats, F.col(key) == F.col("_k"), "left").crossJoin(F.broadcast(prior))
    n, s = F.coalesce("_n", F.lit(0)), F.coalesce("_s", F.lit(0))
    if leave_one_out:
        n, s = n - 1, s - F.col(label)
    out = {f"{key}_count": n, f"{key}_seen": (n > 0).cast("int"), f"{key}_rate": (s + alpha * F.col("_prior")) / (n + alpha)}
    return d.withColumns(out).drop("_k", "_n", "_s", "_prior")


def majority_vote(df: DataFrame, key: str, vote: str) -> DataFrame:
    """(key, n, share, pred): votes of a key; a tie is no majority."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(vote).alias("share")).withColumn("pred", (F.col("share") > 0.5).cast("int"))


def base_rate_blend(df: DataFrame, rates: DataFrame, key: str, pred: str, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Predictions overruled where a key's known rate is extreme; unmatched keys keep the model's."""
    d = df.join(rates.select(F.col(key).alias("_k"), F.col("rate").alias("_r")), F.col(key) == F.col("_k"), "left")
    return d.withColumn(pred, F.when(F.col("_r") < low, 0).when(F.col("_r") > high, 1).otherwise(F.col(pred))).drop("_k", "_r")


def mean_blend(predictions: DataFrame, key: str, score: str) -> DataFrame:
    return predictions.groupBy(key).agg(F.avg(score).alias(score))

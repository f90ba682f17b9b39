"""Evaluation metrics as aggregations: confusion counts, micro and macro summaries, histogram scores, calibration, bootstrap.

Undefined rates are NULL inside (aggregates skip them) and become NaN only where a caller exports them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "fn", "tn")


def _d(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def confusion_rates(digits: int | None = None) -> dict[str, Column]:
    """Rates of tp, fp, fn, tn. Without true positives to find, dice and iou are 1 if nothing was predicted, else 0; other undefined rates are NULL."""
    tp, fp, fn, tn = (_d(c) for c in COUNTS)
    empty = (tp + fn) == 0
    clean = F.when(fp == 0, 1.0).otherwise(0.0)
    out = {
        "dice": F.when(empty, clean).otherwise(F.try_divide(2 * tp, 2 * tp + fp + fn)),
        "iou": F.when(empty, clean).otherwise(F.try_divide(tp, tp + fp + fn)),
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "tpr": F.try_divide(tp, tp + fn),
        "tnr": F.try_divide(tn, tn + fp),
        "precision": F.try_divide(tp, tp + fp),
        "fpr": F.try_divide(fp, fp + tn),
        "fnr": F.try_divide(fn, fn + tp),
    }
    return {k: F.round(v, digits) for k, v in out.items()} if digits is not None else out


def micro(rows: DataFrame) -> DataFrame:
    """Rates of the summed counts."""
    total = rows.agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS))
    return total.select(*COUNTS, *(v.alias(k) for k, v in confusion_rates(6).items()))


def per_entity(rows: DataFrame, entity: str) -> DataFrame:
    g = rows.groupBy(entity).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS))
    return g.select(entity, *COUNTS, *(v.alias(k) for k, v in confusion_rates().items()))


def macro(rows: DataFrame, entity: str) -> DataFrame:
    """Means over entities of their rates, undefined ones left out; dice of entities with positives, clean share of those without."""
    p = per_entity(rows, entity)
    positive = F.col("tp") + F.col("fn") > 0
    return p.agg(
        F.count("*").alias("n_patients"),
        *(F.round(F.avg(k), 6).alias(k) for k in confusion_rates()),
        F.round(F.avg(F.when(positive, F.col("dice"))), 6).alias("dice_pos_only"),
        F.round(F.avg(F.when(~positive, F.when(F.col("fp") == 0, 1.0).otherwise(0.0))), 6).alias("neg_clean_rate"),
        F.count_if(positive).alias("n_pos_patients"),
        F.count_if(~positive).alias("n_neg_patients"),
    )


def suppressed(rows: DataFrame, entity: str, patches: DataFrame, positive_patches: str, least: int) -> DataFrame:
    """One row an entity: if it has fewer positive patches than least, nothing counts as predicted (tp, fp = 0; fn, tn = all of their class)."""
    g = rows.groupBy(entity).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS))
    j = g.join(patches.select(entity, F.col(positive_patches).alias("_k")), entity, "full_outer").fillna(0, [*COUNTS, "_k"])
    s = F.col("_k") < least
    zero = F.lit(0).cast("long")
    return j.select(
        entity,
        F.when(s, zero).otherwise(F.col("tp")).alias("tp"),
        F.when(s, zero).otherwise(F.col("fp")).alias("fp"),
        F.when(s, F.col("tp") + F.col("fn")).otherwise(F.col("fn")).alias("fn"),
        F.when(s, F.col("fp") + F.col("tn")).otherwise(F.col("tn")).alias("tn"),
        s.alias("suppressed"),
    )


def bin_of(p: Column, bins: int) -> Column:
    """min(trunc(p * bins), bins - 1)"""
    return F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1))


def histogram(rows: DataFrame, score: str, truth: str, bins: int) -> DataFrame:
    """Counts for every class and bin, empty ones too."""
    n = rows.groupBy(F.col(truth).alias("truth"), bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(2 * bins).select((F.col("id") / bins).cast("int").alias("truth"), (F.col("id") % bins).cast("int").alias("bin"))
    return grid.join(n, ["truth", "bin"], "left").fillna(0, ["n"])


def at_or_above(rows: DataFrame, score: str, truth: str, bins: int) -> DataFrame:
    """For each bin the counts of both classes in it and above: one row a bin, so the window is over `bins` rows."""
    h = histogram(rows, score, truth, bins).groupBy("bin").agg(F.sum(F.when(F.col("truth") == 1, F.col("n"))).alias("p"), F.sum(F.when(F.col("truth") == 0, F.col("n"))).alias("q"))
    w = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    return h.select("bin", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"))


def histogram_auroc(rows: DataFrame, score: str, truth: str, bins: int) -> DataFrame:
    """Area under the ROC curve by trapezoids, from (0, 0); NULL if a class is missing."""
    t = at_or_above(rows, score, truth, bins)
    w = Window.orderBy(F.desc("bin"))
    total = t.agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    r = t.join(F.broadcast(total)).select("bin", F.try_divide(_d("tp"), _d("P")).alias("tpr"), F.try_divide(_d("fp"), _d("N")).alias("fpr"))
    step = (F.col("fpr") - F.lag("fpr", 1, 0.0).over(w)) * (F.col("tpr") + F.lag("tpr", 1, 0.0).over(w)) / 2
    return r.select(step.alias("a")).agg(F.round(F.sum("a"), 6).alias("auroc"))


def histogram_auprc(rows: DataFrame, score: str, truth: str, bins: int) -> DataFrame:
    """Sum of recall steps times precision, denominators at least 1."""
    t = at_or_above(rows, score, truth, bins)
    total = t.agg(F.greatest(F.max("tp"), F.lit(1)).alias("P"))
    w = Window.orderBy(F.desc("bin"))
    r = t.join(F.broadcast(total)).select("bin", (_d("tp") / _d("P")).alias("recall"), (_d("tp") / _d(F.greatest(F.col("tp") + F.col("fp"), F.lit(1)))).alias("precision"))
    return r.select(((F.col("recall") - F.lag("recall", 1, 0.0).over(w)) * F.col("precision")).alias("a")).agg(F.round(F.sum("a"), 6).alias("auprc"))


def best_mcc(rows: DataFrame, score: str, truth: str, bins: int, thresholds: Sequence[float]) -> DataFrame:
    """Matthews correlation at each threshold (0 if undefined); the largest, of equals at the smallest threshold."""
    t = at_or_above(rows, score, truth, bins)
    total = t.agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    wanted = rows.sparkSession.createDataFrame([(x, min(int(x * bins), bins - 1)) for x in thresholds], "threshold double, bin int")
    j = t.join(F.broadcast(wanted), "bin").join(F.broadcast(total))
    tp, fp, fn, tn = _d("tp"), _d("fp"), _d(F.col("P") - F.col("tp")), _d(F.col("N") - F.col("fp"))
    mcc = F.coalesce(F.try_divide(tp * tn - fp * fn, F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0.0))), F.lit(0.0))
    m = j.select("threshold", F.round(mcc, 6).alias("mcc"))
    return m.agg(F.max(F.struct("mcc", (-F.col("threshold")).alias("k"))).alias("m")).select("m.mcc", (-F.col("m.k")).alias("threshold"))


def exact_average_precision(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """Average precision over exact scores, equal scores together. Scores are aggregated first; the running sums go over ranges of scores."""
    g = rows.groupBy(F.col(score).alias("s")).agg(F.sum(truth).cast("long").alias("p"), F.count("*").alias("n")).withColumn("_r", F.floor(F.col("s") * 256))
    part = g.groupBy("_r").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.orderBy(F.desc("_r"))
    base = part.select("_r", (F.sum("_p").over(above) - F.col("_p")).alias("bp"), (F.sum("_n").over(above) - F.col("_n")).alias("bn"))
    w = Window.partitionBy("_r").orderBy(F.desc("s"))
    run = g.join(base, "_r").select("p", (F.sum("p").over(w) + F.col("bp")).alias("cp"), (F.sum("n").over(w) + F.col("bn")).alias("cn"))
    return run.agg(F.round(F.try_divide(F.sum(_d("p") * _d("cp") / _d("cn")), F.sum(_d("p"))), 6).alias("average_precision"))


def collapse_guard(rows: DataFrame, score: str, low: float, high: float) -> DataFrame:
    """The share of scores of at least 0.5, only if it is within the bounds (else no row)."""
    return rows.agg(F.avg((F.col(score) >= 0.5).cast("double")).alias("prevalence")).where((F.col("prevalence") >= low) & (F.col("prevalence") <= high))


def threshold_by_f1(rows: DataFrame, rate: str, truth: str, grid: Sequence[float]) -> DataFrame:
    """The threshold (first of equals) with the best F1 of rate > threshold.

    The rows are counted once by how many thresholds lie below them; the grid is joined to
    those few counts.
    """
    below = F.lit(0)
    for g in grid:
        below = below + F.when(F.col(rate) > g, 1).otherwise(0)
    n = rows.select(below.alias("k"), F.col(truth).alias("t")).groupBy("k").agg(F.count_if(F.col("t") == 1).alias("p"), F.count_if(F.col("t") == 0).alias("q"))
    taus = rows.sparkSession.createDataFrame([(i, float(g)) for i, g in enumerate(grid)], "i int, threshold double")
    j = F.broadcast(taus).join(n, F.col("k") >= 0).groupBy("i", "threshold").agg(
        F.sum(F.when(F.col("k") > F.col("i"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") > F.col("i"), F.col("q")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("k") <= F.col("i"), F.col("p")).otherwise(0)).alias("fn")
    )
    f1 = F.round(F.coalesce(F.try_divide(2 * _d("tp"), 2 * _d("tp") + _d("fp") + _d("fn")), F.lit(0.0)), 6)
    best = F.max(F.struct(f1.alias("f1"), (-F.col("i")).alias("k"), "threshold")).alias("b")
    return j.agg(best).select("b.threshold", "b.f1")


def bootstrap(rows: DataFrame, entity: str, replicates: int, seed: int, level: float = 0.95, least_entities: int = 20) -> DataFrame:
    """Percentile intervals of micro and macro dice over entities drawn with replacement; none below least_entities.

    Replicates are Poisson draws: each entity gets a count for each replicate from a
    generator seeded by the replicate and the entity, so entities stay where they are and only sums
    (a row for each replicate) are shuffled.
    """
    p = per_entity(rows, entity).select(entity, *COUNTS, "dice")
    if p.limit(least_entities).count() < least_entities:
        return rows.sparkSession.createDataFrame([], "metric string, low double, high double")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, 5))
        for f in frames:
            for key, tp, fp, fn, dice in zip(f[entity], f["tp"], f["fp"], f["fn"], f["dice"], strict=True):
                k = np.random.default_rng([seed, int(key) % 2**32 if isinstance(key, (int, np.integer)) else zlib.crc32(str(key).encode())]).poisson(1.0, replicates)
                total += k[:, None] * np.array([2 * tp, 2 * tp + fp + fn, 0.0 if np.isnan(dice) else dice, 0.0 if np.isnan(dice) else 1.0, 1.0])
        yield pd.DataFrame(total, columns=["a", "b", "c", "d", "e"]).assign(r=np.arange(replicates))

    sums = p.mapInPandas(draw, "a double, b double, c double, d double, e double, r long").groupBy("r").agg(*(F.sum(c).alias(c) for c in "abcde"))
    each = sums.select(F.try_divide(F.col("a"), F.col("b")).alias("micro_dice"), F.try_divide(F.col("c"), F.col("d")).alias("macro_dice"))
    tail = (1 - level) / 2
    return each.agg(*(F.percentile(m, F.lit(q)).alias(f"{m}_{n}") for m in ("micro_dice", "macro_dice") for n, q in (("low", tail), ("high", 1 - tail)))).select(
        F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_low").alias("low"), F.col(f"{m}_high").alias("high")) for m in ("micro_dice", "macro_dice")))).alias("x")
    ).select("x.*")


def grid_scores(facts: DataFrame, entity: str) -> DataFrame:
    """Calibration candidates scored from facts (candidate columns and an entity's counts under them).

    Facts hold one row for each entity and candidate threshold, already counted; candidates
    are never joined to pixels.
    """
    positive = F.col("tp") + F.col("fn") > 0
    dice = F.when(positive, F.try_divide(2 * _d("tp"), 2 * _d("tp") + _d("fp") + _d("fn")))
    tpr = F.when(positive, F.coalesce(F.try_divide(_d("tp"), _d("tp") + _d("fn")), F.lit(0.0)))
    clean = F.when(~positive, F.when(F.col("fp") == 0, 1.0).otherwise(0.0))
    keys = [c for c in facts.columns if c not in (entity, *COUNTS)]
    return facts.groupBy(*keys).agg(
        F.round(F.coalesce(F.avg(dice), F.lit(0.0)), 6).alias("positive_dice"),
        F.round(F.coalesce(F.avg(tpr), F.lit(0.0)), 6).alias("positive_tpr"),
        F.round(F.coalesce(F.avg(clean), F.lit(0.0)), 6).alias("negative_clean_rate"),
        F.round(F.coalesce(F.avg(F.try_divide(_d("tp"), _d("tp") + _d("fp"))), F.lit(0.0)), 6).alias("macro_precision"),
        F.round(F.try_divide(F.coalesce(F.sum(dice), F.lit(0.0)) + F.coalesce(F.sum(clean), F.lit(0.0)), _d(F.count("*"))), 6).alias("macro_score"),
        F.round(F.coalesce(F.try_divide(2 * _d(F.sum("tp")), 2 * _d(F.sum("tp")) + _d(F.sum("fp")) + _d(F.sum("fn"))), F.lit(0.0)), 6).alias("micro_dice"),
    )


def select_candidate(scores: DataFrame, key: str, guard: dict[str, float]) -> DataFrame:
    """The best candidate of the best tier that has any: target_met, target_infeasible, micro_guardrail_infeasible, positive_guardrail_infeasible."""
    pos = (F.col("positive_dice") >= guard["positive_dice"]) & (F.col("positive_tpr") >= guard["positive_tpr"])
    mic = pos & (F.col("micro_dice") >= guard["micro_dice"])
    met = mic & (F.col("negative_clean_rate") >= guard["negative_clean_rate"]) & (F.col("macro_precision") >= guard["macro_precision"]) & (F.col("positive_tpr") >= guard["macro_tpr"])
    tier = F.when(met, 3).when(mic, 2).when(pos, 1).otherwise(0)
    order = F.struct(tier.alias("tier"), "macro_score", "negative_clean_rate", "positive_tpr", "positive_dice", "micro_dice", "macro_precision", (-F.col(key)).alias("k"))
    best = scores.agg(F.max(order).alias("b"), *(F.count_if(c).alias(n) for c, n in ((pos, "n_positive"), (mic, "n_micro"), (met, "n_target"))))
    names = F.element_at(F.array(*(F.lit(s) for s in ("positive_guardrail_infeasible", "micro_guardrail_infeasible", "target_infeasible", "target_met"))), F.col("b.tier") + 1)
    return best.select((-F.col("b.k")).alias(key), names.alias("status"), F.col("b.macro_score").alias("macro_score"), "n_positive", "n_micro", "n_target")


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table."""
    c = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda x: x * (x - 1) / 2
    pair = lambda t: t.agg(F.sum(two(_d("n"))).alias("s"))
    s = pair(c).select(F.col("s").alias("ab"))
    sa = pair(rows.groupBy(a).agg(F.count("*").alias("n"))).select(F.col("s").alias("a"))
    sb = pair(rows.groupBy(b).agg(F.count("*").alias("n"))).select(F.col("s").alias("b"))
    n = rows.agg(two(_d(F.count("*"))).alias("t"))
    j = s.join(F.broadcast(sa)).join(F.broadcast(sb)).join(F.broadcast(n))  # one row each
    expected = F.col("a") * F.col("b") / F.col("t")
    return j.select(F.round(F.coalesce(F.try_divide(F.col("ab") - expected, (F.col("a") + F.col("b")) / 2 - expected), F.lit(1.0)), 6).alias("ari"))

"""Sampling, splitting and subset selection.

Random order is a seeded arithmetic hash of the key, so that samples do not depend on
partitioning and another engine can replay them. Sequential kernels run once per entity on
numpy arrays; only the one over entities (greedy_split) sees a table of one row an entity.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str | Column, seed: int) -> Column:
    """A pseudo-random order of integer keys: exact in 64 bits, so any engine gives the same."""
    k = F.col(key) if isinstance(key, str) else key
    return ((k % 1_000_003) * 48_271 + seed * 7_919 + F.floor(k / 1_000_003)) % 2_147_483_647


def shuffled_sql(key: str, seed: int) -> str:
    return f"((({key}) % 1000003) * 48271 + {seed * 7919} + CAST(floor(({key}) / 1000003) AS BIGINT)) % 2147483647"


def top_ratio(rows: DataFrame, group: str, value: str, position: str, ratio: float, least: int) -> DataFrame:
    """Of each group the largest round(ratio * n) rows (half to even), at least `least`, at most all."""
    w = Window.partitionBy(group)
    k = F.least(F.greatest(F.bround(F.lit(ratio) * F.col("_n")), F.lit(least)), F.col("_n"))
    ranked = rows.withColumn("_n", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc(value), position)))
    return ranked.where(F.col("_rn") <= k).drop("_rn", "_n")


def stratified_sample(rows: DataFrame, strata: Sequence[str], key: str, ratio: float, seed: int) -> DataFrame:
    """ceil(ratio * n) rows of each stratum, in shuffled order."""
    w = Window.partitionBy(*strata)
    ranked = rows.withColumn("_n", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(shuffled(key, seed), key)))
    return ranked.where(F.col("_rn") <= F.ceil(F.lit(ratio) * F.col("_n"))).drop("_rn", "_n")


def simple_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(shuffled(key, seed), key).limit(n)


def pool_and_pilot(rows: DataFrame, key: str, pool: int, pilot: int, seed: int) -> DataFrame:
    """The first `pool` keys in shuffled order, of which the first `pilot` are the pilot."""
    top = rows.select(key).distinct().orderBy(shuffled(key, seed), key).limit(pool)
    rn = F.row_number().over(Window.orderBy(shuffled(key, seed), key))  # over the pool only
    return top.withColumn("_rn", rn).select(key, F.when(F.col("_rn") <= pilot, "pilot").otherwise("master").alias("part"))


def holdout(entities: DataFrame, key: str, label: str, seed: int, shares: tuple[float, float] = (0.2, 0.2)) -> DataFrame:
    """Three disjoint sets, each class dealt in shuffled order; every set gets one of a class that has three."""
    w = Window.partitionBy(label)
    t = entities.withColumn("_n", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(shuffled(key, seed), key)))
    a = F.greatest(F.lit(1), F.floor(F.col("_n") * shares[0]))
    b = F.greatest(F.lit(1), F.floor(F.col("_n") * shares[1]))
    part = F.when(F.col("_rn") <= a, "calibration").when(F.col("_rn") <= a + b, "holdout").otherwise("fit")
    return t.select(key, label, part.alias("part"))


def latin_hypercube(spark, n: int, dims: int, seed: int) -> DataFrame:
    """n points: in each dimension every one of n strata once, at its middle, in shuffled order."""
    cells = spark.range(n * dims).select((F.col("id") % n).alias("point"), F.floor(F.col("id") / n).alias("dim"))
    order = shuffled(F.col("point") + 131 * (F.col("dim") + 1), seed)
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(order, "point"))
    return cells.select("point", "dim", ((rank - 0.5) / n).alias("value"))


def weighted_draws(rows: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement by inverse CDF: each row's share of n + shuffled offsets is floor'd, without a range join.

    Systematic sampling: draw i stands at (i + u) / n of the total weight, so the number of
    draws in a row is how many of these points its stretch holds. Stretches come from
    partial sums over blocks of keys.
    """
    t = rows.select(key, F.col(weight).cast("double").alias("_w")).withColumn("_b", F.floor(F.col(key) / 4096))
    blocks = t.groupBy("_b").agg(F.sum("_w").alias("_s"))
    base = blocks.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_base"))
    total = blocks.agg(F.sum("_s").alias("_t"))
    past = F.sum("_w").over(Window.partitionBy("_b").orderBy(key)) + F.col("_base")
    u = (seed * 7919 % 1000) / 1000
    at = lambda c: F.ceil(F.round(c / F.col("_t") * n - u, 9))
    return t.join(F.broadcast(total)).join(base, "_b").withColumn("_past", past).select(key, (at(F.col("_past")) - at(F.col("_past") - F.col("_w"))).cast("long").alias("draws")).where("draws > 0")


def quota_sample(rows: DataFrame, cluster: str, position: str, wanted: int) -> DataFrame:
    """ceil(wanted / clusters) of each cluster by position, then the smallest positions left, to `wanted`."""
    k = rows.agg(F.count_distinct(cluster).alias("_k"))
    t = rows.join(F.broadcast(k)).withColumn("_rn", F.row_number().over(Window.partitionBy(cluster).orderBy(position)))
    over = (F.col("_rn") > F.ceil(F.lit(wanted) / F.col("_k"))).cast("int")
    return t.withColumn("_over", over).orderBy("_over", position).limit(wanted).drop("_k", "_rn", "_over")


def largest_remainder(groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Quotas in proportion to size that sum to total: floors, and one more for the largest remainders. One row a group."""
    t = groups.join(F.broadcast(groups.agg(F.sum(size).alias("_t")))).withColumn("_x", F.col(size) * total / F.col("_t"))
    t = t.withColumn("_f", F.floor("_x")).withColumn("_r", F.round(F.col("_x") - F.col("_f"), 9))
    rest = F.lit(total) - F.sum("_f").over(Window.partitionBy(F.lit(0)))
    rn = F.row_number().over(Window.orderBy(F.desc("_r"), key))
    return t.select(key, (F.col("_f") + F.when(rn <= rest, 1).otherwise(0)).cast("long").alias("quota"))


SPLITS = ("TEST", "VALIDATION", "TRAIN")


def allocate(totals: Sequence[int], positives: Sequence[int], ratio: float, quota: dict[str, int]) -> list[str]:
    """For each entity in order the split with room whose share of positives comes nearest to ratio; of equals TEST; TRAIN once both are full."""
    have = {s: [0, 0, 0] for s in SPLITS}
    out = []
    for n, p in zip(totals, positives, strict=True):
        open_ = [s for s in SPLITS[:2] if have[s][0] < quota[s]] or ["TRAIN"]
        near = [abs((have[s][2] + p) / (have[s][1] + n) - ratio) if have[s][1] + n > 0 else abs(ratio) for s in open_]
        best = open_[min(range(len(open_)), key=near.__getitem__)]
        have[best] = [have[best][0] + 1, have[best][1] + n, have[best][2] + p]
        out.append(best)
    return out


def greedy_split(entities: DataFrame, key: str, order: Sequence[str], ratio: float, quota: dict[str, int]) -> DataFrame:
    """allocate() over entities(key, total, positive, ...), which is one row an entity: inherently one after another."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([*order, key], kind="stable")
        return pd.DataFrame({key: f[key], "split": allocate(f["total"].tolist(), f["positive"].tolist(), ratio, quota)})

    return entities.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"{key} long, split string")


ENTITIES = 1_000_000  # entities (24 bytes each) that a search sends to every executor; more are an error


def search_split(entities: DataFrame, key: str, ratio: float, quota: dict[str, int], trials: int, seed: int) -> DataFrame:
    """The best of `trials` seeded orders: smallest summed distance of the splits' ratios from ratio, both classes in each; of equals the first.

    Trials are dealt to tasks; the entities, of which every trial needs all, are broadcast. Only a trial's loss comes back.
    """
    spark = entities.sparkSession
    f = entities.select(F.col(key).cast("long"), F.col("total").cast("long"), F.col("positive").cast("long")).limit(ENTITIES + 1).toPandas().sort_values(key)
    if len(f) > ENTITIES:
        raise ValueError(f"a search takes at most {ENTITIES} entities")
    held = spark.sparkContext.broadcast([f[c].to_numpy() for c in (key, "total", "positive")])

    def dealt(trial: int) -> pd.DataFrame:
        ids, total, positive = held.value
        at = np.random.default_rng([seed, trial]).permutation(len(ids))
        return pd.DataFrame({key: ids[at], "total": total[at], "positive": positive[at], "split": allocate(total[at].tolist(), positive[at].tolist(), ratio, quota)})

    def lost(trial: int) -> float:
        g = dealt(trial).groupby("split")[["total", "positive"]].sum()
        both = all(0 < r.positive < r.total for r in g.itertuples())
        return float((g["positive"] / g["total"] - ratio).abs().sum()) + (0.0 if both else 10.0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            yield pd.DataFrame({"trial": t["id"], "loss": [lost(int(i)) for i in t["id"]]})

    losses = spark.range(0, trials if len(f) else 0, 1, max(1, min(trials, 1024))).mapInPandas(run, "trial long, loss double")
    best = losses.agg(F.min(F.struct("loss", "trial")).alias("b")).first()["b"]
    told = f"{key} long, split string, trial long, loss double"
    if best is None:
        return spark.createDataFrame([], told)
    return spark.createDataFrame(dealt(best["trial"])[[key, "split"]].assign(trial=best["trial"], loss=best["loss"]), told)


def group_folds(entities: DataFrame, key: str, folds: int) -> DataFrame:
    """Stratified group k-fold: entities in falling order of size go to the fold that leaves positives and sizes most even.

    Folds are backed off to the number of entities of the smaller class. One row an entity.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        k = max(2, min(folds, int((f["positive"] > 0).sum()), int((f["positive"] == 0).sum())))
        f = f.sort_values(["total", key], ascending=[False, True], kind="stable")
        load = np.zeros((k, 2))
        out = []
        for n, p in zip(f["total"], f["positive"], strict=True):
            cost = [np.std(np.where(np.arange(k) == i, load[:, 1] + p, load[:, 1])) + 0.1 * np.std(np.where(np.arange(k) == i, load[:, 0] + n, load[:, 0])) for i in range(k)]
            i = int(np.argmin(np.round(cost, 9)))
            load[i] += (n, p)
            out.append(i)
        return pd.DataFrame({key: f[key], "fold": out})

    return entities.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"{key} long, fold int")


# Subsets of vectors, per entity


def distances(points: np.ndarray) -> np.ndarray:
    square = (points * points).sum(1)
    d = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * points @ points.T))
    np.fill_diagonal(d, 0)
    return d


def diverse_subset(points: np.ndarray, most: int, eps: float = 0.1) -> list[int]:
    """Positions of at most `most` points: the best of greedy independent sets over a sweep of distance thresholds.

    A set's worth is facility location (each point's similarity to its nearest chosen one)
    plus the smallest distance inside it.
    """
    n = len(points)
    if n <= most or most <= 0:
        return list(range(n)) if most > 0 else []
    d = distances(points.astype(np.float64))
    widest = d.max()
    near = 1 - d / widest if widest > 0 else np.ones_like(d)
    order = np.lexsort((np.arange(n), -near.sum(0)))

    def independent(threshold: float) -> list[int]:
        chosen: list[int] = []
        gap = np.full(n, np.inf)
        for i in order:
            if len(chosen) == most:
                break
            if chosen and gap[i] < threshold:
                continue
            chosen.append(int(i))
            gap = np.minimum(gap, d[i])
        return chosen

    def worth(chosen: list[int]) -> float:
        inner = d[np.ix_(chosen, chosen)] + np.diag(np.full(len(chosen), np.inf))
        return float(near[:, chosen].max(1).sum()) + (float(inner.min()) if len(chosen) > 1 else widest)

    steps = 1 + int(math.log(2 / eps) / math.log(1 + eps)) if widest > 0 else 0
    candidates = [independent(0.0)]
    if most >= 2:
        candidates.append(list(divmod(int(d.argmax()), n)))
    candidates += [independent(eps * widest / 2 * (1 + eps) ** k) for k in range(steps)]
    return max(candidates, key=worth)


def coverage_curve(points: np.ndarray, order: Iterable[int]) -> Iterator[float]:
    """Mean distance of all points to the nearest of the first k in order, for k = 1, 2, ...; each is worked out when asked for."""
    gap = np.full(len(points), np.inf)
    for i in order:
        gap = np.minimum(gap, np.sqrt(np.maximum(0, ((points - points[i]) ** 2).sum(1))))
        yield float(gap.mean())


def plateau(curve: Iterable[float], tolerance: float, patience: int) -> int:
    """How many of the curve to keep: up to where the relative improvement stays below tolerance for `patience` steps."""
    still, k, last = 0, 0, None
    for k, x in enumerate(curve, 1):
        if last is not None:
            gain = (last - x) / last if last > 0 else 0.0
            still = still + 1 if gain < tolerance else 0
            if still >= patience:
                return k
        last = x
    return k


def early_stop(scores: Sequence[float], delta: float, patience: int) -> int:
    """The step at which training stops: the best only moves by more than delta; -1 if it runs on."""
    best, wait = None, 0
    for k, s in enumerate(scores):
        if best is None or s > best + delta:
            best, wait = s, 0
        else:
            wait += 1
            if wait >= patience:
                return k
    return -1


CANDIDATES = 4096  # points of one entity that the quadratic kernels see


def select_diverse(rows: DataFrame, entity: str, position: str, vector: str, most: int) -> DataFrame:
    """diverse_subset per entity; entities with more than CANDIDATES points are first narrowed to a shuffled pool of that size."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(position)
        kept = diverse_subset(np.stack(f[vector].to_numpy()), most)
        return f.iloc[sorted(kept)][[entity, position]]

    pool = Window.partitionBy(entity).orderBy(shuffled(position, 1), position)
    t = rows.select(entity, position, vector).withColumn("_rn", F.row_number().over(pool)).where(F.col("_rn") <= CANDIDATES).drop("_rn")
    kinds = dict(rows.dtypes)
    return t.groupBy(entity).applyInPandas(run, f"{entity} {kinds[entity]}, {position} {kinds[position]}")


def select_adaptive(rows: DataFrame, entity: str, position: str, vector: str, tolerance: float, patience: int) -> DataFrame:
    """Per entity the points up to the plateau of coverage, in order of position. All points count; a step costs one pass over the entity's."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(position)
        points = np.stack(f[vector].to_numpy()).astype(np.float64)
        return f.iloc[: plateau(coverage_curve(points, range(len(points))), tolerance, patience)][[entity, position]]

    kinds = dict(rows.dtypes)
    return rows.select(entity, position, vector).groupBy(entity).applyInPandas(run, f"{entity} {kinds[entity]}, {position} {kinds[position]}")

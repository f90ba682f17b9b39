"""Objectives of weight search as aggregations over (trial, patient) facts, and the record of the chosen ensemble.

Trials that a search would stop early are marked as pruned: the limits are on final values,
so stopping early only saves work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.relational import positions


def region_objective(facts: DataFrame, trial: str, limits: dict[str, float]) -> DataFrame:
    """Per trial the mean recall of regions over patients with positives, less a penalty for region area on the others.

    facts: hit (positive pixels in the region), region, truth, size for each trial and patient. Pruned if too
    many regions are empty, recall is too low, or the median region is too large for the density of positives.
    """
    positive = F.col("truth") > 0
    area = F.col("region") / F.col("size")
    t = facts.groupBy(trial).agg(
        F.coalesce(F.avg(F.when(positive, F.col("hit") / (F.col("truth") + 1e-7))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.when(~positive, area)), F.lit(0.0)).alias("negative_area"),
        F.avg((F.col("region") == 0).cast("double")).alias("empty"),
        F.median(area).alias("median_area"),
        F.avg(F.col("truth") / F.col("size")).alias("density"),
    )
    most = F.greatest(F.lit(limits["median"]), F.col("density") + 0.15)
    status = F.when(F.col("empty") > limits["empty"], "empty").when(F.col("recall") < limits["recall"], "misses").when(F.col("median_area") > most, "permissive").otherwise("ok")
    value = F.when(status == "ok", F.round(F.col("recall") - limits["penalty"] * F.col("negative_area"), 6))
    return t.select(trial, status.alias("status"), value.alias("objective"))


def spatial_objective(facts: DataFrame, trial: str, spill_penalty: float, negative_penalty: float) -> DataFrame:
    """Per trial: mean ap of positive patients - spill_penalty * mean share of mass outside - negative_penalty * mean prediction on the others.

    facts: positive (boolean), ap, outside, mass, mean for each trial and patient.
    """
    positive = F.col("positive")
    t = facts.groupBy(trial).agg(
        F.coalesce(F.avg(F.when(positive, F.col("ap"))), F.lit(0.0)).alias("a"),
        F.avg(F.col("outside") / (F.col("mass") + 1e-7)).alias("s"),
        F.coalesce(F.avg(F.when(~positive, F.col("mean"))), F.lit(0.0)).alias("n"),
    )
    return t.select(trial, F.round(F.col("a") - spill_penalty * F.col("s") - negative_penalty * F.col("n"), 6).alias("objective"))


def recipe(models: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """models with role and weight (none and 0 where weights(key, role, weight) has no row), in order: semantic, spatial, none, each by falling weight."""
    j = models.join(weights, key, "left").withColumn("role", F.coalesce("role", F.lit("none"))).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    order = F.when(F.col("role") == "semantic", 0).when(F.col("role") == "spatial", 1).otherwise(2)
    return positions(j, [order, -F.col("weight")], [key], "position")

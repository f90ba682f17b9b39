"""Aggregates, windows, joins and set operations per entity, as DataFrame to DataFrame functions.

All are equi-joins, hash aggregates with a map-side part, or windows partitioned by an
entity; none collects. Where ties matter a position column makes the order total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_table(rows: DataFrame, entity: str, label: str) -> DataFrame:
    """Rows, positive rows, other rows, share of positives and a 0/1 label for each entity."""
    t = rows.groupBy(entity).agg(F.count("*").alias("total"), F.sum(label).cast("long").alias("positive"))
    return t.select(entity, "total", "positive", (F.col("total") - F.col("positive")).alias("negative"), (F.col("positive") / F.col("total")).alias("ratio"), (F.col("positive") > 0).cast("int").alias("label"))


def global_ratio(rows: DataFrame, label: str) -> DataFrame:
    """The share of positive rows; NULL (an error to the caller) without rows."""
    return rows.agg(F.try_divide(F.sum(label).cast("double"), F.count("*").cast("double")).alias("ratio"))


def availability(rows: DataFrame, split: str, accepted: str, selected: str) -> DataFrame:
    """Rows, accepted rows and selected rows by split; rows without a split are named <NULL>."""
    return rows.groupBy(F.coalesce(F.col(split), F.lit("<NULL>")).alias(split)).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(accepted) == 1).alias("n_accepted"),
        F.count_if((F.col(accepted) == 1) & (F.col(selected) == 1)).alias("n_selected"),
    )


def split_statistics(rows: DataFrame, split: str, entity: str, label: str) -> DataFrame:
    """One row for each split with rows: entities, their classes, the distribution of rows per entity, class counts."""
    per = rows.groupBy(split, entity).agg(F.count("*").alias("n"), F.max(label).alias("any"), F.count_if(F.col(label) == 1).alias("pos"))
    q = lambda p: F.percentile("n", F.lit(p))  # noqa: E731  exact, linear
    return per.groupBy(split).agg(
        F.count("*").alias("n_patients"),
        F.count_if(F.col("any") == 1).alias("n_pos_patients"),
        F.count_if(F.col("any") == 0).alias("n_neg_patients"),
        F.sum("n").alias("n_images"),
        F.round(F.avg("n"), 6).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("std"),
        F.min("n").alias("min"),
        q(0.25).alias("q1"),
        q(0.5).alias("median"),
        q(0.75).alias("q3"),
        F.max("n").alias("max"),
        F.sum(F.col("n") - F.col("pos")).alias("n_images_neg"),
        F.sum("pos").alias("n_images_pos"),
    )


def size_check(rows: DataFrame, entity: str) -> DataFrame:
    """Rows per entity with the population deviation, and whether the largest is far above the median."""
    per = rows.groupBy(entity).agg(F.count("*").alias("n"))
    t = per.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"), F.min("n").alias("min"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("max"))
    return t.withColumn("warn", F.col("max") > 20 * F.greatest(F.lit(1.0), F.col("median")))


def first_max_row(rows: DataFrame, entity: str, value: str, position: str) -> DataFrame:
    """The row of the largest value of each entity; of equals the first by position."""
    w = Window.partitionBy(entity).orderBy(F.desc(value), position)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def leaked_entities(rows: DataFrame, entity: str, split: str) -> DataFrame:
    """Entities in more than one split; rows without a split do not count."""
    return rows.groupBy(entity).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def surplus_duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows are copies of another by the keys, NULL keys included."""
    return rows.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def repeated_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def distinct_listed(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values as one ordered string; NULL if there are none."""
    return rows.agg(F.nullif(F.concat_ws(",", F.array_sort(F.collect_set(column))), F.lit("")).alias("listed"))


def islands(rows: DataFrame, group: str, index: str) -> DataFrame:
    """Runs of consecutive index values in each group: first, past (exclusive) and length."""
    d = rows.select(group, index).distinct()
    key = F.col(index) - F.row_number().over(Window.partitionBy(group).orderBy(index))
    return d.withColumn("_k", key).groupBy(group, "_k").agg(F.min(index).alias("first"), (F.max(index) + 1).alias("past"), F.count("*").alias("length")).drop("_k")


def offsets(rows: DataFrame, entity: str) -> DataFrame:
    """start and stop of each entity's slice when all rows stand one entity after another.

    The running sum is over one row an entity: a partial sum for each of a few hundred
    ranges of entities comes first, so that no single task orders all entities.
    """
    per = rows.groupBy(entity).agg(F.count("*").alias("n"))
    ranged = per.withColumn("_block", F.floor(F.col(entity) / 4096))
    blocks = ranged.groupBy("_block").agg(F.sum("n").alias("_sum"))
    base = blocks.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_base"))
    stop = F.sum("n").over(Window.partitionBy("_block").orderBy(entity)) + F.col("_base")
    return ranged.join(base, "_block").withColumn("stop", stop).select(entity, (F.col("stop") - F.col("n")).alias("start"), "stop")


def positions(rows: DataFrame, blocks: Sequence[str | Column], order: Sequence[str | Column], position: str) -> DataFrame:
    """rows with their place from 1 in the order of blocks and then order, without one task that sees all rows.

    blocks: columns whose values cut the rows into stretches that follow each other; rows are numbered inside
    their stretch, and only the stretches' counts are summed up in one task.
    """
    keys = [f"_b{i}" for i in range(len(blocks))]
    t = rows.withColumns({k: F.col(b) if isinstance(b, str) else b for k, b in zip(keys, blocks, strict=True)})
    sizes = t.groupBy(*keys).agg(F.count("*").alias("_n"))
    base = sizes.select(*keys, (F.sum("_n").over(Window.orderBy(*keys)) - F.col("_n")).alias("_base"))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return t.join(base, keys).withColumn(position, (rn + F.col("_base")).cast("long")).drop(*keys, "_base")


def ordered_lookup(keys: DataFrame, table: DataFrame, on: Sequence[str], position: str) -> DataFrame:
    """keys with the columns of table, in the keys' order; missed says which found nothing."""
    found = table.withColumn("_hit", F.lit(True))
    return keys.join(found, list(on), "left").withColumn("missed", F.col("_hit").isNull()).drop("_hit").orderBy(position)


def full_compare(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys on one side only, or with different values: status is missing_left, missing_right or differs."""
    a = left.select(*keys, F.struct(*columns).alias("_a"))
    b = right.select(*keys, F.struct(*columns).alias("_b"))
    status = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return a.join(b, list(keys), "full_outer").withColumn("status", status).where("status is not null").select(*keys, "status")


def difference_both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of one side only, with the side."""
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def sorted_dedup(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Each value once, at its first position."""
    return rows.groupBy(value).agg(F.min(position).alias(position))


def interleaved(rows: DataFrame, group: str, order: Sequence[str | Column], position: str = "position") -> DataFrame:
    """One of each group in turn: the first of every group, then the second of every group, ..."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_rn", rn).withColumn(position, F.struct("_rn", group)).drop("_rn")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """rows with 1 / (rows of the same class). The counts are one row a class and are joined back."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    return rows.join(F.broadcast(n), label).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def phase_profile(rows: DataFrame, phase: str, seconds: str) -> DataFrame:
    """Sum, calls, mean and share of the total of each phase."""
    t = rows.groupBy(phase).agg(F.sum(seconds).alias("_s"), F.count("*").alias("calls"))
    total = t.agg(F.sum("_s").alias("_t"))
    j = t.join(F.broadcast(total))
    return j.select(phase, F.round("_s", 6).alias("seconds"), "calls", F.round(F.col("_s") / F.col("calls"), 6).alias("mean_seconds"), F.round(F.coalesce(F.try_divide(F.col("_s"), F.col("_t")), F.lit(0.0)), 6).alias("share"))


def with_total(rows: DataFrame, key: str, counts: dict[str, Column]) -> DataFrame:
    """Counts by key and a TOTAL row."""
    aggs = [c.alias(n) for n, c in counts.items()]
    return rows.rollup(key).agg(F.grouping(key).alias("_g"), *aggs).withColumn(key, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(key))).drop("_g")

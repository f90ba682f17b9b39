"""The mergeable accumulators on streams: the same aggregations, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.metrics import bin_of


def streaming_histogram(rows: DataFrame, score: str, truth: str, bins: int) -> DataFrame:
    """Counts by class and bin (non-empty ones); for output mode update or complete."""
    return rows.groupBy(F.col(truth).alias("truth"), bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"))


def streaming_confusion(rows: DataFrame, entity: str, score: str, truth: str, threshold: float) -> DataFrame:
    """Confusion counts of each entity."""
    hit, yes = F.col(score) > threshold, F.col(truth) == 1
    return rows.groupBy(entity).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))


def windowed_counts(events: DataFrame, time: str, kind: str, length: str, late: str) -> DataFrame:
    """Counts by kind and time window; rows later than `late` behind the newest are dropped, closed windows are final."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def run_once(stream: DataFrame, checkpoint: str, name: str, mode: str = "complete") -> None:
    """Processes what is there into a table in memory of the given name (tests, backfills)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

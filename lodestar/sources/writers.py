"""Sinks. Tables are written in parallel; single files only for small reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.scratch import filesystem


def write_shards(rows: DataFrame, path: str, shard: str) -> None:
    """Replaces the shards that occur in rows, each with its rows, and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)


def drop_shards(spark: SparkSession, path: str, shard: str, values: Sequence[str]) -> None:
    """Removes shards that have no rows any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for v in values:
        at = hadoop.Path(f"{path}/{shard}={v}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def append_index(rows: DataFrame, path: str) -> None:
    """Adds to a Parquet index; no rows still leave files with the schema."""
    rows.write.mode("append").parquet(path)


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A small report as one file."""
    one = rows.coalesce(1).write.mode("overwrite")
    one.option("header", "true").csv(path) if kind == "csv" else one.json(path)


def publish(rows: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Writes beside path, reads back, and only then takes path's place; gives the number of rows.

    Fails, and leaves path as it was, if keys repeat in what was written. The old table is put aside, not
    removed, until the new one is in its place; one that a lost driver has left aside is put back first.
    """
    spark = rows.sparkSession
    staged, aside = f"{path}.staged", f"{path}.aside"
    (fs, old), (_, new), (_, spare) = (filesystem(spark, p) for p in (path, staged, aside))
    if fs.exists(spare):
        if fs.exists(old):
            fs.delete(spare, True)
        elif not fs.rename(spare, old):
            raise OSError(f"{aside} could not be put back")
    rows.write.mode("overwrite").parquet(staged)
    back = spark.read.parquet(staged)
    n = back.count()
    if back.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"keys {list(keys)} repeat in what was written; {path} is as it was")
    if fs.exists(old) and not fs.rename(old, spare):
        raise OSError(f"{path} could not be put aside")
    if not fs.rename(new, old):
        if fs.exists(spare):
            fs.rename(spare, old)
        raise OSError(f"{staged} could not be renamed")
    fs.delete(spare, True)
    return n


def write_splits(rows: DataFrame, path: str, split: str, order: Sequence[str]) -> None:
    """One folder for each split, sorted by the unique order columns, and read back; fails if any row differs."""
    rows.repartitionByRange(split, *order).sortWithinPartitions(split, *order).write.mode("overwrite").partitionBy(split).parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    if not same_rows(back, rows):
        raise ValueError(f"{path} does not hold the rows of the splits")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    a, b = left.select(*sorted(left.columns)), right.select(*sorted(right.columns))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def upsert_manifest(manifest: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """A manifest with the changed rows in place of those of the same key, in order of key."""
    return manifest.join(changed.select(key), key, "left_anti").unionByName(changed).orderBy(F.col(key))

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, by any path that Spark's reader opens."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only a local session (tests) that names none gets a temporary one; on a cluster that is an error,
    as each machine would write to its own disk.
    """
    ship(spark)
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        found = sc.getCheckpointDir()
    return found


_WRITTEN: list[tuple[SparkSession, str]] = []  # scratch tables that are still there, in the order of writing


def _path_of(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again.

    The copy outlives lost executors; it is removed by dropped(), with its Scratch block or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-scratch-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    files, at = _path_of(spark, path)
    files.deleteOnExit(at)
    # Spark removes the shuffle files of a finished job only when the driver's JVM collects their handles; on a
    # large input they would else fill the disks, and a collection costs the driver's heap, whatever the data's size.
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    _WRITTEN.append((spark, path))
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    _remove({t._lodestar_path for t in tables})


def _remove(paths: set[str]) -> None:
    for spark, path in [w for w in _WRITTEN if w[1] in paths]:
        files, at = _path_of(spark, path)
        files.delete(at, True)
        _WRITTEN.remove((spark, path))


class Scratch:
    """A block after which the tables written inside it are removed, but for those given to keep()."""

    def __enter__(self) -> Scratch:
        self.before, self.kept = {path for _, path in _WRITTEN}, set()
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table._lodestar_path)
        return table

    def __exit__(self, *_) -> None:
        _remove({path for _, path in _WRITTEN} - self.before - self.kept)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lead_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns of df: extra columns, whatever their names, stay out of the plan."""
    ship(df.sparkSession)
    return df.select(*(F.col(f"`{n}`") for n in names))


_HOLDER: list = ["", lambda: None]


def hold(owner: str, drop: Callable[[], object]) -> None:
    """In a Python worker: lets go of what another operator's tasks have kept there, and notes how to drop the owner's.

    Workers outlive tasks, and so do their caches; only those of the operator at work stay.
    """
    if _HOLDER[0] != owner:
        _HOLDER[1]()
        pa.default_memory_pool().release_unused()
    _HOLDER[:] = [owner, drop]


Query = Callable[[SparkSession, str], DataFrame]

"""A store of runs and of the state that they leave. A version is one folder, published by one rename."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.state import update_by_key
from lodestar.sources.scratch import filesystem

RUNS = "run_id long, stage string, config_path string, config_sha256 string, completed_at timestamp"


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, at = filesystem(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n[8:]) for n in names if n.startswith("version_"))


def _publish(spark: SparkSession, path: str, staged: str, number: int) -> None:
    files, at = filesystem(spark, staged)
    if not files.rename(at, filesystem(spark, f"{path}/version_{number}")[1]):
        raise OSError(f"{staged} could not be renamed")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The runs and the state of the latest version."""
    at = f"{path}/version_{_versions(spark, path)[-1]}"
    return spark.read.parquet(f"{at}/runs"), spark.read.parquet(f"{at}/state")


def create_store(state: DataFrame, path: str) -> None:
    """A store without runs. state: a key, selected and last_stage."""
    spark = state.sparkSession
    staged = f"{path}/_staged"
    state.write.mode("overwrite").parquet(f"{staged}/state")
    spark.createDataFrame([], RUNS).write.mode("overwrite").parquet(f"{staged}/runs")
    _publish(spark, path, staged, 0)


def record_run(spark: SparkSession, path: str, stage: str, decisions: DataFrame, key: str, config: tuple[str | None, str | None] = (None, None)) -> int:
    """Adds a run of the stage and its decisions(key, selected), all or nothing; gives the run's id.

    Verified on what was written: the rows last changed by the stage are as many as the decisions, and so are
    the selected ones. Else it fails and the store is as it was. config: path and digest.
    """
    runs, state = read_store(spark, path)
    staged = f"{path}/_staged"
    changes = decisions.select(key, F.col("selected").cast(state.schema["selected"].dataType).alias("selected"), F.lit(stage).alias("last_stage"))
    update_by_key(state, changes, key, ["selected", "last_stage"]).write.mode("overwrite").parquet(f"{staged}/state")
    run_id = (runs.agg(F.max("run_id")).first()[0] or 0) + 1
    row = spark.createDataFrame([(run_id, stage, *config)], "run_id long, stage string, config_path string, config_sha256 string")
    runs.unionByName(row.withColumn("completed_at", F.current_timestamp())).write.mode("overwrite").parquet(f"{staged}/runs")
    told = lambda t: tuple(t.agg(F.count("*"), F.count_if(F.col("selected") == 1)).first())
    want, got = told(changes), told(spark.read.parquet(f"{staged}/state").where(F.col("last_stage") == stage))
    if want != got:
        files, at = filesystem(spark, staged)
        files.delete(at, True)
        raise ValueError(f"decisions of {stage}: expected {want} rows and selected rows, found {got}; nothing was changed")
    _publish(spark, path, staged, _versions(spark, path)[-1] + 1)
    return run_id

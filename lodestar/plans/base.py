"""The lineage relations over the driver's tables, and the registry that the query modules fill.

A patch is an order, a patient a customer, a shard all orders of a customer; the state of a
patch comes from its order's status and line items. Each relation has a DataFrame here and
a CTE of the same meaning for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str = "") -> Callable[[Query], Query]:
    """Registers a query, with its oracle after the CTEs that it needs (names between spaces)."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql is not None:
            ctes = [CTE[n] for n in needs.split()]
            body = sql.strip()
            if ctes and body.upper().startswith("WITH "):
                body = ", " + body[5:]
            ORACLE[name] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("patch_id"),
        F.col("o_custkey").alias("patient_id"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 3 == 0)).cast("int").alias("label"),
        F.concat(F.lit("MANIFEST::shard_"), F.col("o_custkey").cast("string"), F.lit(".h5")).alias("shard"),
        F.concat(F.lit("PATIENT_"), F.col("o_custkey").cast("string"), F.lit("_PATCH_"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("filename"),
        F.col("o_totalprice").alias("score"),
    )


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patches with their row index in the shard."""
    order = Window.partitionBy("patient_id").orderBy("patch_id")
    return patches(spark, sf_dir).withColumn("row_index", (F.row_number().over(order) - 1).cast("long"))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_custkey") * 7919 % 100
    return o.select(
        F.col("o_orderkey").alias("patch_id"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("is_accepted"),
        F.when(F.col("o_orderkey") % 50 == 0, None).when(key < 20, "TEST").when(key < 40, "VALIDATION").otherwise("TRAIN").alias("split"),
        F.when(F.col("o_orderkey") % 4 == 0, 1).when(F.col("o_orderkey") % 4 == 1, 0).alias("is_selected"),
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per patch what its line items say; patches without any have no row."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("patch_id")).agg(F.round(F.avg("l_discount"), 6).alias("rate"), F.max("l_tax").alias("cover"), F.count("*").alias("n_lines"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability and a truth for each event."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 500)).alias("p"), (F.col("event_type") == "error").cast("int").alias("truth"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of each order's line items: flagged by discount, truth by return."""
    li = read(spark, sf_dir, "lineitem")
    pred, truth = F.col("l_discount") >= 0.06, (F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 2 == 0)
    rows = li.select("l_orderkey", F.col("l_suppkey").alias("patient_id"), pred.alias("pred"), truth.alias("truth"))
    return rows.groupBy(F.col("l_orderkey").alias("patch_id")).agg(
        F.min("patient_id").alias("patient_id"),
        F.count_if(F.col("pred") & F.col("truth")).alias("tp"),
        F.count_if(F.col("pred") & ~F.col("truth")).alias("fp"),
        F.count_if(~F.col("pred") & F.col("truth")).alias("fn"),
        F.count_if(~F.col("pred") & ~F.col("truth")).alias("tn"),
    )


CTE = {
    "patches": """patches AS (SELECT o_orderkey AS patch_id, o_custkey AS patient_id,
      CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS label,
      'MANIFEST::shard_' || CAST(o_custkey AS VARCHAR) || '.h5' AS shard,
      'PATIENT_' || CAST(o_custkey AS VARCHAR) || '_PATCH_' || CAST(o_orderkey AS VARCHAR) || '.png' AS filename,
      o_totalprice AS score FROM orders)""",
    "indexed": """indexed AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY patch_id) - 1 AS row_index FROM patches)""",
    "state": """state AS (SELECT o_orderkey AS patch_id,
      CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS is_accepted,
      CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_custkey * 7919 % 100 < 20 THEN 'TEST' WHEN o_custkey * 7919 % 100 < 40 THEN 'VALIDATION' ELSE 'TRAIN' END AS split,
      CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS is_selected FROM orders)""",
    "rates": """rates AS (SELECT l_orderkey AS patch_id, round(avg(l_discount), 6) AS rate, max(l_tax) AS cover, count(*) AS n_lines FROM lineitem GROUP BY 1)""",
    "scored": """scored AS (SELECT event_id, user_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 500)) AS p, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS truth FROM events)""",
    "confusion": """confusion AS (SELECT l_orderkey AS patch_id, min(l_suppkey) AS patient_id,
      count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp,
      count(*) FILTER (NOT pred AND truth) AS fn, count(*) FILTER (NOT pred AND NOT truth) AS tn
      FROM (SELECT l_orderkey, l_suppkey, l_discount >= 0.06 AS pred, l_returnflag = 'R' AND l_orderkey % 2 = 0 AS truth FROM lineitem) GROUP BY 1)""",
}

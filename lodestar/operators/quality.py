"""Checks that give a status, integrity, and joins with rules about ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.references import patient_of, portable_candidates
from lodestar.operators.relational import leaked_entities, repeated_values, surplus_duplicates

SEVERITY = {"N/A": 0, "PASS": 1, "WARN": 2, "FAIL": 3}


def check(scope: str, name: str, found: DataFrame, bad: str = "FAIL") -> DataFrame:
    """One row: bad if found(n) is above 0, else PASS."""
    return found.select(F.lit(scope).alias("scope"), F.lit(name).alias("check"), F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, bad).otherwise("PASS").alias("status"))


def count_where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.agg(F.count_if(condition).alias("n"))


def size_of(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def verdict(checks: DataFrame, scope: str) -> DataFrame:
    """checks and a row with the worst of their statuses."""
    severity = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    worst = checks.agg(F.max(F.struct(severity[F.col("status")].alias("k"), "status"))["status"].alias("status"))
    return checks.unionByName(worst.select(F.lit(scope).alias("scope"), F.lit("overall").alias("check"), "status"))


def suite(manifest: DataFrame, items: DataFrame) -> DataFrame:
    """The dataset checks, each one row, and the verdict."""
    named = patient_of(F.col("filename"))
    parts = [
        check("dataset", "duplicate_rows", surplus_duplicates(items, ["l_orderkey", "l_linenumber"]).withColumnRenamed("n_duplicates", "n")),
        check("dataset", "patient_leakage", size_of(leaked_entities(manifest, "patient_id", "split"))),
        check("dataset", "filename_uniqueness", size_of(repeated_values(manifest, "filename"))),
        check("dataset", "filename_patient", count_where(manifest, named.isNull() | (named != F.col("patient_id")))),
        check("dataset", "valid_labels", count_where(manifest, ~F.col("label").isin(0, 1))),
        check("dataset", "missing_splits", count_where(manifest, F.col("split").isNull()), "WARN"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return verdict(out, "dataset")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """How many rows of child have no parent."""
    left = child.select(F.col(key).alias("_k")).join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return left.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("key"), "orphans")


def two_phase_lookup(records: DataFrame, index: DataFrame, path: str, target: str) -> DataFrame:
    """path, target, how: by the exact path, else by the portable keys of both; several targets are ambiguous and give none."""
    exact = records.select(path).distinct().join(index.select(path, target), path, "left")
    found = exact.where(F.col(target).isNotNull()).withColumn("how", F.lit("exact"))
    rest = exact.where(F.col(target).isNull()).select(path)
    keys = lambda t, *more: t.select(*more, F.explode(portable_candidates(F.col(path))).alias("_key"))
    tried = keys(rest, path).join(keys(index, target), "_key").groupBy(path).agg(F.collect_set(target).alias("_t"))
    one = F.size("_t") == 1
    j = rest.join(tried, path, "left").select(path, F.when(one, F.col("_t")[0]).alias(target), F.when(F.col("_t").isNull(), "missing").when(one, "portable").otherwise("ambiguous").alias("how"))
    return found.select(path, target, "how").unionByName(j)


def unambiguous(regions: DataFrame, others: DataFrame, cell: int) -> DataFrame:
    """Regions (box, x0, y0, x1, y1) that overlap none of the others in a positive area, by a grid join of what is distinct on either side."""
    ends = ["x0", "y0", "x1", "y1"]
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor((hi - 1e-9) / cell))
    grid = lambda t: t.withColumn("cx", F.explode(span(F.col("x0"), F.col("x1")))).withColumn("cy", F.explode(span(F.col("y0"), F.col("y1"))))
    b = grid(others.select(*ends).distinct()).select(*(F.col(c).alias(f"o_{c}") for c in ("cx", "cy", *ends)))
    meet = F.expr("cx = o_cx and cy = o_cy and x0 < o_x1 and o_x0 < x1 and y0 < o_y1 and o_y0 < y1")
    hit = grid(regions.select(*ends).distinct()).join(b, meet, "left_semi").select(*ends).distinct()
    return regions.select("box", *ends).join(hit, ends, "left_anti").select("box")

"""State changes as DataFrame functions: (old table, changes) -> new table. Callers write the result to a new place and swap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the rows whose key occurs in new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def update_by_key(old: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """old with the columns that changes gives (a NULL there changes nothing)."""
    c = changes.select(key, *(F.col(x).alias(f"_new_{x}") for x in columns))
    out = [F.coalesce(F.col(f"_new_{x}"), F.col(x)).alias(x) if x in columns else F.col(x) for x in old.columns]
    return old.join(c, key, "left").select(*out)


def sync_queue(queue: DataFrame, members: DataFrame, key: str, signature: str, position: str) -> DataFrame:
    """The work queue after a scan: new members wait, members with another signature wait again, the others stay.

    Of members with one name the last counts.
    """
    last = members.groupBy(key).agg(F.max(F.struct(position, signature))[signature].alias("_sig"))
    j = queue.join(last, key, "full_outer")
    changed = F.col("status").isNull() | (F.col("_sig").isNotNull() & ~F.col(signature).eqNullSafe(F.col("_sig")))
    return j.select(key, F.coalesce("_sig", signature).alias(signature), F.when(changed, "PENDING").otherwise(F.col("status")).alias("status"))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and those rows of new whose keys it has not; of new rows with equal keys one."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def with_new_ids(old: DataFrame, new: DataFrame, id_column: str, order: Sequence[str]) -> DataFrame:
    """new with ids above those of old, in order. One window over the new rows, which are few (a run, an artifact)."""
    top = old.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    return new.crossJoin(F.broadcast(top)).withColumn(id_column, F.col("_top") + F.row_number().over(Window.orderBy(*order))).drop("_top")


def links_break_rule(links: DataFrame, artifacts: DataFrame, bundle: str, artifact: str, method: str) -> DataFrame:
    """Bundles that more than one artifact of a method is linked to."""
    return links.join(artifacts, artifact).groupBy(bundle, F.upper(method).alias(method)).agg(F.count("*").alias("n")).where("n > 1")


def all_or_nothing(old: DataFrame, new: DataFrame, expected: int, key: str) -> DataFrame:
    """new if it has as many distinct keys as expected, else old (a failed run leaves the table as it was)."""
    return new if new.select(key).distinct().count() == expected else old

"""Content signatures: canonical JSON, row sets, metadata. Column expressions over sha2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys (equal to a canonical writer for ASCII text)."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def joined_digest(columns: Sequence[Column], separator: str = "|") -> Column:
    """SHA-256 of the values as text with a separator; NULL is empty."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def short_digest(value: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(value, 256), 1, length)


def row_set_digest(rows: DataFrame, group: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One signature for the rows of each group in order.

    Rows become digests first; what is gathered is 64 characters a row and group. For a
    group of any size order the digests in blocks and sign the blocks.
    """
    d = rows.select(*group, (F.floor(F.col(order) / 4096)).alias("_b"), F.col(order).alias("_o"), joined_digest([F.col(c) for c in columns]).alias("_d"))
    signed = lambda o: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, "_d"))), lambda x: x["_d"]), ""), 256)
    blocks = d.groupBy(*group, "_b").agg(signed("_o").alias("_d"))
    return blocks.groupBy(*group).agg(signed("_b").alias("signature"))

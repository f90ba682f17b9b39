"""What both searches over vectors share: which rows take part, and groups of queries that data stream past."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import lead_columns, shuffle_partitions

GROUP = 4096  # queries that one task holds
HELD = 1 << 15  # data that one task holds at a time
SLICE = 1 << 18  # data that one task reads


def usable(table: DataFrame, zero: bool) -> DataFrame:
    """vec_id, vector (array of double) of the rows that take part: no nulls, only finite components, of the commonest length.

    zero: whether zero vectors take part. Of lengths equally common the smallest counts.
    """
    rows = lead_columns(table, ["vec_id", "embedding"]).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and vector is not null and size(vector) > 0").where(fine)
    if not zero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["n"] if sizes else -1))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def grouped(counts: dict[int, int], centres: np.ndarray, most: int = GROUP) -> tuple[dict[int, int], dict[int, int]]:
    """The group of each cell that has queries, and into how many parts each group is cut.

    Cells are taken as a chain, each the nearest to the one before it, and share a group while
    it has at most `most` queries; a cell with more is a group of several parts.
    """
    group, total, last = {}, {}, None
    left = [c for c in sorted(counts) if counts[c]]
    while left:
        c = left[0] if last is None else left[int(((centres[left] - centres[last]) ** 2).sum(1).argmin())]
        left.remove(c)
        g = len(total) - 1
        if last is None or total[g] + counts[c] > most:
            g += 1
            total[g] = 0
        group[c], last = g, c
        total[g] += counts[c]
    return group, {g: -(-n // most) for g, n in total.items()}


def slices(rows: int, partitions: int) -> int:
    """Over how many tasks the data of one group are dealt: all cores have work, and no task reads more than about SLICE."""
    return max(-(-rows // SLICE), min(partitions, -(-rows // 4096)), 1)


Solve = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]

UNIT = ["grp", "part", "slice"]


def past_groups(data: DataFrame, queries: DataFrame, solve: Solve, data_type: str, query_type: str, score: pa.DataType) -> DataFrame:
    """query_id, vec_id, score of what solve finds for the queries of each unit (grp, part, slice) in its data.

    data(grp, part, slice, id, cell, payload), queries(grp, part, slice, id, payload). A unit's queries
    are at most GROUP or so and are held; its data stream past them, HELD rows at a time.
    solve(data ids, cells, data, query ids, queries) gives positions of queries, ids found and scores;
    data are sorted by id.
    """

    def table(raw: list[bytes], kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, q_ids, asked, ids, cells, held = None, [], [], [], [], []
        q = None

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal q, ids, cells, held
            if asked and held:
                if q is None:
                    q = np.array(q_ids, np.int64), table(asked, query_type)
                own = np.array(ids, np.int64)
                by = np.argsort(own, kind="stable")
                who, found, value = solve(own[by], np.array(cells, np.int32)[by], table(held, data_type)[by], *q)
                yield pa.RecordBatch.from_arrays([pa.array(q[0][who]), pa.array(found, pa.int64()), pa.array(value, score)], ["query_id", "vec_id", "score"])
            ids, cells, held = [], [], []

        for batch in batches:
            for *at, kind, i, cell, payload in zip(*(batch.column(c).to_pylist() for c in (*UNIT, "kind", "id", "cell", "payload")), strict=True):
                if at != unit:
                    yield from answer()
                    unit, q_ids, asked, q = at, [], [], None
                if kind == 0:
                    q_ids.append(i)
                    asked.append(payload)
                elif asked:
                    ids.append(i)
                    cells.append(cell)
                    held.append(payload)
                    if len(ids) >= HELD:
                        yield from answer()
        yield from answer()

    both = queries.select(*UNIT, F.lit(0).alias("kind"), "id", F.lit(-1).alias("cell"), "payload").unionByName(data.select(*UNIT, F.lit(1).alias("kind"), "id", "cell", "payload"))
    n = shuffle_partitions(data.sparkSession)
    kind = "long" if pa.types.is_integer(score) else "double"
    return both.repartition(n, *UNIT).sortWithinPartitions(*UNIT, "kind").mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank from 1; ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

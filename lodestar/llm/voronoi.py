"""Exact top-k by integer inner product through a Voronoi kNN join (operator 8).

Vectors become integers, floor(scale * x). Largest inner product is nearest neighbour once
each data vector x gets one more component sqrt(M - |x|^2), M the largest squared norm, and
each query a 0: the squared distance is then |q|^2 + M - 2 q.x.

Pivots (as many as the square root of the rows, to PIVOTS, from a bounded sample) cut the space into
cells; data and queries belong to the cell of their nearest pivot. Summaries (per cell the count, the
range of distances to its pivot and the k + 1 smallest of them over distinct vec_ids; per cell of queries
the largest distance) give each cell of queries a bound on its k-th distance. Neighbouring cells of queries
share a group of bounded size. By the triangle inequality a data vector can only be a neighbour of a group's
query if its distance to its own pivot lies in an interval for this group and cell; it is replicated
to those groups and no others, and each group is solved locally. The queries of a group are sent once to
each slice of its data, so that no task reads more than a bounded part of them. Bounds have a margin for
rounding; scores are exact integers.

Defined cases: null vectors, and those with null or non-finite components, take no part,
nor do those of another length than the commonest; zero vectors do. A query's own vec_id is
no candidate, so a vec_id that is repeated is none for itself. Rows that repeat a queried vec_id and its
vector ask once; different vectors of one vec_id are asked each, and the best of all their answers
count. Rows that repeat a candidate count each. Ties go to the smaller vec_id. With fewer candidates
than k all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, shuffle_partitions, table, written
from lodestar.llm.vectors import GROUP, grouped, matrix, past_groups, ranked, slices, usable

SCALE = 256
K = 5
EVERY = 50
PIVOTS = 1024  # at most; their distances from each other are a matrix on the driver
SAMPLE = 2048


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(x * scale).astype(np.int64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: as floating point while every partial sum is below 2^53, else as integers of 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    return q.astype(np.float64) @ x.T.astype(np.float64) if most < 2**53 else q @ x.T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row, but for the row's own id; of equals the first. ids are sorted. Scores are changed."""
    none = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    a, z = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
    for i in np.flatnonzero(z > a):
        scores[i, a[i] : z[i]] = none
    left = len(ids) - (z - a)
    rows = np.arange(len(scores))
    who, found, value = [], [], []
    for turn in range(min(k, scores.shape[1])):
        j = scores.argmax(1)
        ok = left > turn
        who.append(rows[ok])
        found.append(ids[j[ok]])
        value.append(scores[rows, j][ok])
        scores[rows, j] = none
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *who]), np.concatenate([empty, *found]), np.concatenate([np.zeros(0, scores.dtype), *value])


class Space:
    """The pivots in the space with one more component, and distances to them."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.most = most
        self.pivots = self.lifted(pivots)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(0, self.most - (x * x).sum(1)))])

    def to_pivots(self, x: np.ndarray, query: bool) -> np.ndarray:
        lifted = np.column_stack([x.astype(np.float64), np.zeros(len(x))]) if query else self.lifted(x)
        square = (lifted * lifted).sum(1)[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0, square))


def pivots_of(drawn: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those before it."""
    chosen = [0]
    far = ((drawn - drawn[0]).astype(float) ** 2).sum(1)
    while len(chosen) < min(n, len(drawn)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((drawn - drawn[chosen[-1]]).astype(float) ** 2).sum(1))
    return drawn[chosen]


def nearest_join(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, pivots: int | None = None, group: int = GROUP) -> DataFrame:
    """query_id, vec_id, score (long) of the k best for each query, and some more. rows: from usable()."""
    spark = rows.sparkSession
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    most, n_rows = rows.agg(F.max(norm), F.count("*")).first()
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(8)), "vec_id").limit(SAMPLE).collect() if n_rows else []
    if not sample:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    drawn = np.unique(integers(np.array([r["vector"] for r in sample]), scale), axis=0)
    space = Space(pivots_of(drawn, pivots or min(PIVOTS, max(16, int(n_rows**0.5)))), float(most))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            if not len(b):
                continue
            x = integers(matrix(b.column("vector")), scale)
            d = space.to_pivots(x, False)
            own = np.flatnonzero(b.column("vec_id").to_numpy() % every == 0)
            asks, to = np.full(len(x), -1, np.int32), np.zeros(len(x))
            if len(own):
                dq = space.to_pivots(x[own], True)
                asks[own], to[own] = dq.argmin(1), dq.min(1)
            cell = d.argmin(1)
            deal = np.arange(done, done + len(x))
            done += len(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), pa.array(asks), pa.array(to), pa.array(deal), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "cell", "d", "asks", "to", "deal", "payload"])

    placed = written(rows.mapInArrow(place, "vec_id long, cell int, d double, asks int, to double, deal long, payload binary"))

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict[int, pd.Series] = {}
        count: dict[int, int] = {}
        far: dict[int, float] = {}
        reach: dict[int, float] = {}
        asked: dict[int, int] = {}
        for f in frames:
            for c, rows in f.groupby("cell"):
                d = rows["d"]
                low = d.groupby(rows["vec_id"]).min().nsmallest(k + 1)
                near[c] = (pd.concat([near[c], low]).groupby(level=0).min() if c in near else low).nsmallest(k + 1)
                count[c] = count.get(c, 0) + len(d)
                far[c] = max(far.get(c, 0.0), d.max())
            for g, t in f[f["asks"] >= 0].groupby("asks")["to"]:
                reach[g] = max(reach.get(g, 0.0), t.max())
                asked[g] = asked.get(g, 0) + len(t)
        yield pd.DataFrame([(int(c), count.get(c, 0), far.get(c, 0.0), [{"d": float(d), "id": int(i)} for i, d in near[c].items()] if c in near else [], reach.get(c, -1.0), asked.get(c, 0)) for c in {*count, *reach}], columns=["cell", "n", "far", "near", "reach", "asked"])

    parts = written(placed.select("vec_id", "cell", "d", "asks", "to").mapInPandas(summarise, "cell int, n long, far double, near array<struct<d: double, id: long>>, reach double, asked long"))
    summary = {r["cell"]: r for r in parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.max("reach").alias("reach"), F.sum("asked").alias("asked")).collect()}
    low = parts.select("cell", F.inline("near")).groupBy("cell", "id").agg(F.min("d").alias("d"))
    nearest = {r["cell"]: r["near"] for r in low.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k + 1).alias("near")).collect()}
    cells = [c for c in range(len(space.pivots)) if c in summary and summary[c]["n"]]
    between = np.sqrt(np.maximum(0, (space.pivots**2).sum(1)[:, None] + (space.pivots**2).sum(1)[None, :] - 2 * space.pivots @ space.pivots.T))
    # A query's pivot distance is to the lifted pivot, so the triangle inequality holds between them as they are.
    slack = 1e-7 * (float(most) ** 0.5 + 1) + 1e-6
    near_d = np.array([x["d"] for c in cells for x in nearest[c]])
    near_id = np.array([x["id"] for c in cells for x in nearest[c]], np.int64)
    near_cell = np.array([c for c in cells for _ in nearest[c]], np.int64)

    def kth(to_pivot: np.ndarray) -> float:
        """A bound on the k-th distance, one's own vec_id aside, from distances to the pivots; a vec_id takes one place."""
        ups = to_pivot[near_cell] + near_d
        order = np.argsort(ups, kind="stable")
        ups = np.sort(ups[order[np.unique(near_id[order], return_index=True)[1]]])
        return float(ups[k]) + slack if len(ups) > k else np.inf

    own_group, n_parts = grouped({c: r["asked"] for c, r in summary.items()}, space.pivots, group)
    away = between[:, cells]
    lows, highs = {}, {}  # of each group: the interval of distances to the pivot of each cell, for any of its cells of queries
    for c, g in own_group.items():
        reach = summary[c]["reach"]
        bound = kth(between[c] + reach)
        low_c, high_c = away[c] - reach - bound - slack, away[c] + reach + bound + slack
        lows[g] = np.minimum(lows.get(g, np.inf), low_c)
        highs[g] = np.maximum(highs.get(g, -np.inf), high_c)
    partitions = shuffle_partitions(spark)
    needs, n_slices = [], {}
    for g in lows:
        needed = [(i, c) for i, c in enumerate(cells) if lows[g][i] <= summary[c]["far"]]
        n_slices[g] = slices(sum(summary[c]["n"] for _, c in needed), partitions)
        needs += [(g, c, float(lows[g][i]), float(highs[g][i]), n_parts[g], n_slices[g]) for i, c in needed]
    if not needs:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    # At most PIVOTS groups before parts, times PIVOTS cells.
    wanted = spark.createDataFrame(needs, "grp int, cell int, low double, high double, parts int, slices int")
    data = placed.join(wanted, "cell").where("d between low and high").select("grp", F.expr("explode(sequence(0, parts - 1))").alias("part"), F.expr("cast(pmod(deal, slices) as int)").alias("slice"), F.col("vec_id").alias("id"), "cell", "payload")
    asks = spark.createDataFrame([(c, g, n_parts[g], n_slices[g]) for c, g in own_group.items()], "asks int, grp int, parts int, slices int")
    queries = placed.where("asks >= 0").select("vec_id", "asks", "payload").dropDuplicates(["vec_id", "payload"]).join(asks, "asks")
    queries = queries.select("grp", F.expr("cast(pmod(xxhash64(vec_id, payload), parts) as int)").alias("part"), F.expr("explode(sequence(0, slices - 1))").alias("slice"), F.col("vec_id").alias("id"), "payload")

    def solve(ids, _, x, q_ids, q):
        some = [best(products(q[s : s + 512], x), ids, q_ids[s : s + 512], k) for s in range(0, len(q), 512)]
        who, found, score = (np.concatenate([r[i] + (512 * t if i == 0 else 0) for t, r in enumerate(some)]) for i in range(3))
        return who, found, score.astype(np.int64)

    return past_groups(data, queries, solve, "<i8", "<i8", pa.int64())


def op8_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch() as scratch:
        return scratch.keep(written(ranked(nearest_join(usable(table(spark, sf_dir, "embeddings"), zero=True)), K)))


#: floor(256 * x) of x as double; every pair of a query and another row.
ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % {EVERY} = 0) q JOIN v c ON c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= {K}
"""

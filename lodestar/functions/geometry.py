"""Polygons: clipping, area, membership, coverage of windows; tiles over a plane. Numpy kernels and grid joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def clipped(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """The part of a ring inside a rectangle (Sutherland-Hodgman)."""
    out = np.asarray(ring, float)
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(out):
            break
        after = np.roll(out, -1, axis=0)
        a, b = sign * (out[:, axis] - bound), sign * (after[:, axis] - bound)
        made = []
        for p, q, da, db in zip(out, after, a, b, strict=True):
            if da >= 0:
                made.append(p)
            if (da >= 0) != (db >= 0):
                made.append(p + (q - p) * (da / (da - db)))
        out = np.array(made).reshape(-1, 2)
    return out


def coverage(ring: np.ndarray, x: float, y: float, size: float) -> float:
    """The share of a square window that the ring covers."""
    return min(1.0, area(clipped(ring, x, y, x + size, y + size)) / (size * size))


def contains(ring: np.ndarray, x: float, y: float) -> bool:
    """Even-odd rule."""
    a, b = ring, np.roll(ring, -1, axis=0)
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return bool((spans & (x < at)).sum() % 2)


def nm_to_pixels(value_nm: float, centre_nm: float, nm_per_pixel: float, size: int) -> float:
    """A stage coordinate in nanometres from the slide's centre as a pixel from its corner."""
    return (value_nm - centre_nm) / nm_per_pixel + size / 2


def tiles(areas: DataFrame, key: str, width: str, height: str, size: int, stride: int) -> DataFrame:
    """key, x, y of every window of each area that is fully inside."""
    xs = F.sequence(F.lit(0), F.col(width) - size, F.lit(stride))
    ys = F.sequence(F.lit(0), F.col(height) - size, F.lit(stride))
    fits = areas.where((F.col(width) >= size) & (F.col(height) >= size))
    return fits.select(key, F.explode(xs).alias("x"), height).select(key, "x", F.explode(ys).alias("y"))


def shaped(t: DataFrame, columns: list[str]) -> DataFrame:
    """t with a column shape, a 128-bit digest of the columns: rows of one shape meet and overlap the same rows."""
    return t.withColumn("shape", F.unhex(F.md5(F.struct(*columns).cast("string"))))


def shapes(t: DataFrame, columns: list[str]) -> DataFrame:
    """shape and the columns, one row for each shape of t."""
    return t.groupBy("shape").agg(*(F.first(c).alias(c) for c in columns))


def members(t: DataFrame, key: str, block: int = 128) -> DataFrame:
    """shape and the keys of its rows, in arrays of about block: no row grows with the number of copies."""
    sizes = t.groupBy("shape").agg(F.count("*").alias("n"))
    dealt = t.select("shape", key).join(sizes, "shape").withColumn("part", F.pmod(F.xxhash64(key), F.ceil(F.col("n") / block)))
    # Structs, as a list collects no nulls.
    return dealt.repartition("shape", "part").groupBy("shape", "part").agg(F.collect_list(F.struct(key)).alias(key)).select("shape", F.transform(key, lambda k: k[key]).alias(key))


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame, l: str, r: str) -> DataFrame:
    """A row for each two members of the pairs(shape_l, shape_r, ...) of shapes, with the pairs' further columns.

    left and right: as from shaped(), with keys l and r. The pairs are dealt evenly before they grow.
    """
    spark = pairs.sparkSession
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    more = [c for c in pairs.columns if c not in ("shape_l", "shape_r")]
    j = pairs.repartition(n, "shape_l", "shape_r").join(members(left, l).withColumnRenamed("shape", "shape_l"), "shape_l")
    j = j.join(members(right, r).withColumnRenamed("shape", "shape_r"), "shape_r")
    return j.select(F.explode(l).alias(l), r, *more).select(l, F.explode(r).alias(r), *more)


def windows_on_boxes(windows: DataFrame, boxes: DataFrame, size: int, cell: int) -> DataFrame:
    """Pairs of windows (window, x, y) and boxes (box, x0, y0, x1, y1) that overlap in a positive area.

    Both sides' shapes are dealt to the grid cells that they touch and joined by cell; the pair is
    kept in the cell of its overlap's lower corner only, so it comes once. Then the windows and boxes of
    the two shapes take their places.
    """

    def cells(lo, hi):
        return F.sequence(F.floor(lo / cell), F.floor((hi - 1e-9) / cell))

    windows, boxes = shaped(windows, ["x", "y"]), shaped(boxes, ["x0", "y0", "x1", "y1"])
    w = shapes(windows, ["x", "y"]).withColumns({"x1w": F.col("x") + size, "y1w": F.col("y") + size}).withColumnRenamed("shape", "shape_l")
    w = w.withColumn("cx", F.explode(cells(F.col("x"), F.col("x1w")))).withColumn("cy", F.explode(cells(F.col("y"), F.col("y1w"))))
    b = shapes(boxes, ["x0", "y0", "x1", "y1"]).withColumnRenamed("shape", "shape_r")
    b = b.withColumn("cx", F.explode(cells(F.col("x0"), F.col("x1")))).withColumn("cy", F.explode(cells(F.col("y0"), F.col("y1"))))
    j = w.join(b, ["cx", "cy"])
    lx, ly = F.greatest("x", "x0"), F.greatest("y", "y0")
    hx, hy = F.least("x1w", "x1"), F.least("y1w", "y1")
    here = (F.floor(lx / cell) == F.col("cx")) & (F.floor(ly / cell) == F.col("cy"))
    pairs = j.where((lx < hx) & (ly < hy) & here).select("shape_l", "shape_r", ((hx - lx) * (hy - ly)).alias("area"))
    return expanded(pairs, windows, boxes, "window", "box")


def rings_overlap(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two simple rings share a positive area: edges that cross, or one inside the other."""
    return bool(all_rings_overlap(a[None], b[None])[0])


def all_rings_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """rings_overlap of a[k] and b[k] for every k; all rings of a are of one length, and all of b."""
    near = ~((a.max(1) <= b.min(1)).any(1) | (b.max(1) <= a.min(1)).any(1))
    out = np.zeros(len(a), bool)
    a, b = a[near], b[near]

    def side(p, q, r):
        return (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])

    p, q, r, s = a[:, :, None], np.roll(a, -1, axis=1)[:, :, None], b[:, None], np.roll(b, -1, axis=1)[:, None]
    hit = ((side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)).any((1, 2))

    def inside(rings: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether a middle of an edge, or of the first three points, is in the other ring."""
        points = np.concatenate([(rings + np.roll(rings, -1, axis=1)) / 2, rings[:, :3].mean(1, keepdims=True)], axis=1)
        x, y = points[..., None, 0], points[..., None, 1]
        a, b = others[:, None], np.roll(others, -1, axis=1)[:, None]
        spans = (a[..., 1] > y) != (b[..., 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = a[..., 0] + (y - a[..., 1]) * (b[..., 0] - a[..., 0]) / (b[..., 1] - a[..., 1])
        return ((spans & (x < at)).sum(-1) % 2).any(1)

    rest = ~hit
    hit[rest] = inside(a[rest], b[rest]) | inside(b[rest], a[rest])
    out[near] = hit
    return out


def overlapping_polygons(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of ids of left(l, ring) and right(r, ring) whose rings overlap.

    Equal rings are one shape: a grid join on the shapes' bounding boxes, refined in batches; then the ids of the two shapes take their places.
    """
    left, right = shaped(left, ["ring"]), shaped(right, ["ring"])

    def boxed(t: DataFrame, key: str) -> DataFrame:
        xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
        ends = {"lox": F.array_min(xs), "hix": F.array_max(xs), "loy": F.array_min(ys), "hiy": F.array_max(ys)}
        t = shapes(t, ["ring"]).select(F.col("shape").alias(f"shape_{key}"), F.col("ring").alias(f"ring_{key}"), *(v.alias(f"{n}_{key}") for n, v in ends.items()))
        span = lambda c: F.sequence(F.floor(F.col(f"lo{c}_{key}") / cell), F.floor(F.col(f"hi{c}_{key}") / cell))
        return t.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))

    j = boxed(left, "l").join(boxed(right, "r"), ["cx", "cy"]).where("lox_l < hix_r and lox_r < hix_l and loy_l < hiy_r and loy_r < hiy_l")
    first = (F.floor(F.greatest("lox_l", "lox_r") / cell) == F.col("cx")) & (F.floor(F.greatest("loy_l", "loy_r") / cell) == F.col("cy"))
    pairs = j.where(first).select("shape_l", "shape_r", "ring_l", "ring_r")

    def refine(batches):
        for batch in batches:
            rings, sizes, starts = {}, {}, {}
            for k in ("ring_l", "ring_r"):
                points = batch.column(k)
                flat = points.flatten()
                rings[k] = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1)
                sizes[k] = np.diff(points.offsets.to_numpy())
                starts[k] = np.cumsum(sizes[k]) - sizes[k]
            hit = np.zeros(len(batch), bool)
            kinds, of = np.unique(np.stack([sizes["ring_l"], sizes["ring_r"]], axis=1), axis=0, return_inverse=True)
            for i, (p, q) in enumerate(kinds.tolist()):
                rows = np.flatnonzero(of.reshape(-1) == i)
                step = max(1, 1_000_000 // (p * q))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    a, b = (rings[k][starts[k][some][:, None] + np.arange(n)] for k, n in (("ring_l", p), ("ring_r", q)))
                    hit[some] = all_rings_overlap(a, b)
            yield batch.select(["shape_l", "shape_r"]).filter(pa.array(hit))

    # Bounding boxes that overlap are dealt evenly before rings are compared.
    met = pairs.repartition("shape_l", "shape_r").mapInArrow(refine, "shape_l binary, shape_r binary")
    return expanded(met, left, right, "l", "r")

"""Array and mask functions. Those with Column results stay in the JVM; image kernels are numpy for pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))


def weighted_sum(vectors: list[Column], weights: list[float], scale: float = 65535.0, eps: float = 1e-4) -> Column:
    """Sum of fixed-point vectors (value / scale) under weights that are normalised; weights up to eps are left out."""
    kept = [(v, w) for v, w in zip(vectors, weights, strict=True) if w > eps]
    norm = sum(w for _, w in kept) + 1e-9
    parts = [F.transform(v, _scaled(w / norm / scale)) for v, w in kept]
    out = parts[0]
    for part in parts[1:]:
        out = F.zip_with(out, part, lambda a, b: a + b)
    return out


def _scaled(by: float):
    return lambda x: x * by


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def mask_label(mask: Column, threshold: float) -> Column:
    """Whether the share of set pixels is above 0 (threshold 0) or at least threshold."""
    share = total(mask) / F.size(mask)
    return share > 0 if threshold == 0 else share >= threshold


def mask_confusion(pred: Column, truth: Column) -> dict[str, Column]:
    n = lambda p, t: total(F.zip_with(pred, truth, lambda a, b: ((a != 0) == p).cast("int") * ((b != 0) == t).cast("int"))).cast("long")
    return {"tp": n(True, True), "fp": n(True, False), "fn": n(False, True), "tn": n(False, False)}


def entropy(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Shannon entropy (log2) of each key's histogram."""
    t = counts.groupBy(key).agg(F.sum(n).cast("double").alias("_t"))
    p = F.col(n) / F.col("_t")
    return counts.join(t, key).where(F.col(n) > 0).groupBy(key).agg(F.round(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)), 6).alias("entropy"))


def stack_median(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Median of each element over a key's vectors, cut to an integer."""
    e = rows.select(key, F.posexplode(vector).alias("pos", "v"))
    return e.groupBy(key, "pos").agg(F.median(F.col("v").cast("double")).cast("int").alias("value"))


# Numpy kernels


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 4-connected components of a 2-D mask; 0 elsewhere."""
    height, width = mask.shape
    label = np.arange(1, mask.size + 1).reshape(height, width) * (mask != 0)
    while True:
        grown = label.copy()
        for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            for x, y in ((a, b), (b, a)):
                both = (mask[x] != 0) & (mask[y] != 0)
                grown[x] = np.where(both, np.maximum(grown[x], label[y]), grown[x])
        if (grown == label).all():
            break
        label = grown
    _, inverse = np.unique(np.append(label.ravel(), 0), return_inverse=True)
    return inverse[:-1].reshape(height, width)


def filter_components(p: np.ndarray, threshold: float, least_area: int = 0, least_fraction: float = 0.0) -> np.ndarray:
    """The mask p > threshold without components smaller than the larger of least_area and ceil(least_fraction * size)."""
    mask = p > threshold
    least = max(least_area, math.ceil(least_fraction * mask.size))
    label = components(mask)
    sizes = np.bincount(label.ravel())
    keep = sizes >= max(1, least)
    keep[0] = False
    return keep[label]


def largest_component(mask: np.ndarray) -> int:
    sizes = np.bincount(components(mask).ravel())[1:]
    return int(sizes.max()) if len(sizes) else 0


def otsu(values: np.ndarray) -> int:
    """The 8-bit threshold of the largest variance between classes, the first of equals."""
    n = np.bincount(values.ravel().astype(np.int64), minlength=256).astype(float)
    below, mean = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = mean / below - (mean[-1] - mean) / above
        between = np.where((below > 0) & (above > 0), below * above * gap**2, -1.0)
    return int(between.argmax())


def stain_concentrations(rgb: np.ndarray, stains: np.ndarray) -> np.ndarray:
    """Least-squares amounts of the stains (rows of a k x 3 matrix) at each pixel of n x 3 values from 0 to 255."""
    density = -np.log((rgb.astype(float) + 1) / 256)
    return np.linalg.lstsq(stains.T, density.T, rcond=None)[0].T


def restained(rgb: np.ndarray, source: np.ndarray, target: np.ndarray, target_q99: np.ndarray) -> np.ndarray:
    """The pixels under the target's stains, amounts scaled so that their 99th percentiles agree."""
    c = stain_concentrations(rgb, source)
    q = np.maximum(np.percentile(c, 99, axis=0), 1e-6)
    return np.clip(256 * np.exp(-(c / q * target_q99) @ target) - 1, 0, 255).astype(np.uint8)


def flips_mean(predict, image: np.ndarray) -> np.ndarray:
    """Mean prediction over the four flips, each flipped back."""
    flips = [(), (0,), (1,), (0, 1)]
    return np.mean([np.flip(predict(np.flip(image, axis=f)), axis=f) for f in flips], axis=0)


def kept_pixels_udf(threshold: float, least_area: int):
    """A pandas UDF: square probability vectors -> how many pixels stay after filter_components."""

    @F.pandas_udf("int")
    def run(p: pd.Series) -> pd.Series:
        side = lambda v: int(math.isqrt(len(v)))
        return p.map(lambda v: int(filter_components(np.asarray(v)[: side(v) ** 2].reshape(side(v), side(v)), threshold, least_area).sum()))

    return run


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """Whether any pixel of the size x size square around is set."""
    r = size // 2
    padded = np.pad(mask != 0, r)
    out = np.zeros(mask.shape, bool)
    for dy in range(size):
        for dx in range(size):
            out |= padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def eroded(mask: np.ndarray, size: int) -> np.ndarray:
    """Whether all pixels of the square around are set; beyond the edge counts as set."""
    return ~dilated(mask == 0, size)


def tissue_mask(rgb: np.ndarray, opening: int = 3, closing: int = 7) -> np.ndarray:
    """Saturated pixels (Otsu's threshold), small specks removed, small holes filled."""
    high, low = rgb.max(2).astype(float), rgb.min(2).astype(float)
    saturation = np.where(high > 0, np.rint(255 * (high - low) / np.maximum(high, 1)), 0).astype(np.int64)
    mask = saturation > otsu(saturation)
    mask = dilated(eroded(mask, opening), opening)
    return eroded(dilated(mask, closing), closing)

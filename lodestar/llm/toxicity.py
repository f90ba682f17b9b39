"""Toxicity by classifier chains (operator 4).

Categories are predicted one after another by linear (logistic) models: low quality, then
toxic, the two that labels tell. Each model after the first also gets the probabilities of the earlier
categories; in training these are out-of-fold predictions, so that a later model sees them
as wrong as they will be on new documents.

Features: whether a document holds each of the selected markers (words and word beginnings
that go with a category in the labelled rows, by a two-proportion z score), and a few
ratios of its characters and words. Markers are counted on executors; what reaches the
driver are at most MARKERS of them and TRAIN_ROWS short rows.

The classifier is fitted on the TRAIN_ROWS labelled rows of least hash (a bound, stated
here); everything else covers all documents and whole texts.

Defined cases: a null or empty text has no markers and zero ratios and is judged by the
intercepts alone; a label row that repeats a doc_id counts once, a null label not at all;
with no labelled row, or none of a category, its probability is 0; rows that repeat are
judged each alike; an empty table gives an empty one; other columns pass through unchanged:
without_toxic() takes any names, judge() adds its results beside those that it is given.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from lodestar.llm.common import dropped, hold, lead_columns, shuffle_partitions, table, written

CATEGORIES = ("low_quality", "toxic")
TRAIN_ROWS = 10_000
MARKERS = 384
BEGINNINGS = (4, 5)
FOLDS = 5
LEAST_Z = 3.5
CHUNKS_KEPT = 150_000
CHUNK_CHARS = 64  # longer chunks are not remembered
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def chunk_markers(chunk: str) -> tuple[str, ...]:
    """The markers that a lower-case chunk of text without white space can stand for."""
    word = _EDGES.sub("", chunk)
    return (word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)) if word else ()


def ratios(text: str, chunks: list[str]) -> list[float]:
    n, words = max(1, len(text)), max(1, len(chunks))
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(_NOT_LETTERS.sub("", text))
    upper = len(_UPPER.findall(text))
    return [letters / n, upper / n, len(set(chunks)) / words, min(1.0, words / 2000), min(1.0, text.count("!") / words), min(1.0, len(chunks and max(chunks, key=len) or "") / 50), 1.0 if words < 20 else 0.0]


_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
_NOT_LETTERS = re.compile("[^A-Za-z]")
N_RATIOS = 7


@dataclass
class Chain:
    """The selected markers and, for each category, the weights of markers, ratios, earlier probabilities and 1."""

    markers: dict[str, int]
    weights: list[np.ndarray | None]
    reject: float = 0.5  # the probability of the category toxic from which a document goes
    found: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def features(self, text: str | None) -> tuple[list[int], list[float]]:
        text = text or ""
        chunks = text.lower().split()
        if len(self.found) > CHUNKS_KEPT:
            self.found.clear()
        found, markers, own = self.found, self.markers, set()
        for c in set(chunks):
            hit = found.get(c)
            if hit is None:
                hit = tuple(markers[m] for m in chunk_markers(c) if m in markers)
                if len(c) <= CHUNK_CHARS:
                    found[c] = hit
            if hit:
                own.update(hit)
        return sorted(own), ratios(text, chunks) if text else [0.0] * N_RATIOS

    def probabilities(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        x = matrix(rows, len(self.markers))
        out = np.zeros((len(rows), len(CATEGORIES)))
        for j, w in enumerate(self.weights):
            if w is not None:
                out[:, j] = sigmoid(np.column_stack([x, out[:, :j], np.ones(len(rows))]) @ w)
        return out

    def __getstate__(self):
        return {"markers": self.markers, "weights": self.weights, "reject": self.reject, "found": {}}


def matrix(rows: list[tuple[list[int], list[float]]], n_markers: int) -> np.ndarray:
    x = np.zeros((len(rows), n_markers + N_RATIOS), np.float32)
    for i, (own, numbers) in enumerate(rows):
        x[i, own] = 1
        x[i, n_markers:] = numbers
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, ridge: float = 0.3, steps: int = 10) -> np.ndarray:
    """Newton's method; the last column of x is 1 and not penalised."""
    w = np.zeros(x.shape[1]) if start is None else start
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        v = np.maximum(p * (1 - p), 1e-5).astype(x.dtype)
        step = np.linalg.solve((x.T @ (x * v[:, None])).astype(np.float64) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-2:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Weights for each column of labels (0, 1 or NaN), and the out-of-fold probabilities that later columns' models got."""
    n = len(x)
    earlier = np.zeros((n, 0))
    weights: list[np.ndarray | None] = []
    for j in range(labels.shape[1]):
        y, known = labels[:, j], ~np.isnan(labels[:, j])
        full = np.column_stack([x, earlier, np.ones(n)]).astype(np.float32)
        out = np.zeros(n)
        if known.any() and 0 < y[known].mean() < 1:
            weights.append(logistic(full[known], y[known]))
            for k in range(FOLDS):
                inside = known & (folds != k)
                held = folds == k
                if held.any():
                    out[held] = sigmoid(full[held] @ logistic(full[inside], y[inside], weights[-1], steps=4)) if inside.any() and 0 < y[inside].mean() < 1 else y[known].mean()
        else:
            weights.append(None)
        earlier = np.column_stack([earlier, out])
    return weights, earlier


def border(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which a row counts as positive: fewest out-of-fold errors, false alarms twice, the middle of the best gap."""
    if not 0 < y.mean() < 1:
        return 0.5
    by = np.argsort(p, kind="stable")
    z, hit = np.log(np.clip(p[by], 1e-9, 1 - 1e-9) / np.clip(1 - p[by], 1e-9, 1)), y[by] > 0
    errors = np.concatenate([[0], np.cumsum(hit)]) + 2 * np.concatenate([np.cumsum(~hit[::-1])[::-1], [0]])  # of a cut before each row
    gap = np.diff(np.concatenate([z[:1] - 1, z, z[-1:] + 1]))
    best = max(np.flatnonzero((errors == errors.min())), key=lambda i: gap[i])
    low, high = (z[best - 1] if best else z[0] - 1), (z[best] if best < len(z) else z[-1] + 1)
    return float(sigmoid(np.array((low + high) / 2)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Chain:
    """docs(doc_id, text), labels(doc_id, quality, toxic)."""
    spark = docs.sparkSession
    known = lead_columns(labels, ["doc_id", "quality", "toxic"]).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(rows).toPandas()
    if not len(sample):
        return Chain({}, [None] * len(CATEGORIES))
    schema = "doc_id long, toxic int, quality int"
    chosen = spark.createDataFrame([tuple(None if pd.isna(v) else int(v) for v in r) for r in sample[["doc_id", "toxic", "quality"]].itertuples(index=False)], schema)
    # At most `rows` short rows are broadcast. The sample is read from the documents once.
    texts = written(lead_columns(docs, ["doc_id", "text"]).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).repartition(shuffle_partitions(spark)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, ...] = (Counter(), Counter(), Counter())
        for b in batches:
            for text, toxic, quality in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "quality")), strict=True):
                own = {m for c in set((text or "").lower().split()) for m in chunk_markers(c)}
                held[0].update(own)
                if toxic:
                    held[1].update(own)
                if quality == 0:
                    held[2].update(own)
        found = list(held[0].items())
        cols = [[m for m, _ in found], [n for _, n in found], *([h[m] for m, _ in found] for h in held[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), *[pa.int64()] * 3], strict=True)], ["marker", *"ntq"])

    counts = texts.mapInArrow(count, "marker string, n long, t long, q long").groupBy("marker").agg(*(F.sum(c).alias(c) for c in "ntq"))
    total = {"t": int((sample["toxic"] == 1).sum()), "q": int((sample["quality"] == 0).sum())}

    def z(c: str):
        """How far the share of the category's rows that hold a marker is above that of the others, in standard errors."""
        a, b = max(1, total[c]), max(1, len(sample) - total[c])
        pooled = (F.col("n") + 1.0) / (a + b + 2.0)
        return (F.col(c) / F.lit(float(a)) - (F.col("n") - F.col(c)) / F.lit(float(b))) / F.sqrt(pooled * F.abs(1 - pooled) * (1 / a + 1 / b) + 1e-12)

    scored = counts.select("marker", "n", z("t").alias("zt"), z("q").alias("zq")).where("n >= 3")
    toxic_ones = scored.where(F.col("zt") >= LEAST_Z).orderBy(F.desc("zt"), "marker").limit(MARKERS * 2 // 3).collect()
    poor_ones = scored.where(F.col("zq") >= LEAST_Z).orderBy(F.desc("zq"), "marker").limit(MARKERS // 3).collect()
    markers = {m: i for i, m in enumerate(dict.fromkeys(r["marker"] for r in [*toxic_ones, *poor_ones]))}
    chain = Chain(markers, [None] * len(CATEGORIES))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [chain.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([o for o, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float64()))], ["doc_id", "own", "numbers"])

    got = texts.mapInArrow(short, "doc_id long, own array<int>, numbers array<double>").toPandas().sort_values("doc_id").merge(sample, on="doc_id")
    dropped(texts)
    if not len(got):
        return chain
    toxic = got["toxic"].to_numpy(float)
    labels = np.column_stack([1 - got["quality"].to_numpy(float), toxic])
    x = matrix([(list(o), list(v)) for o, v in zip(got["own"], got["numbers"], strict=True)], len(markers))
    chain.weights, held_out = fit_chain(x, labels, got["doc_id"].to_numpy() % FOLDS)
    chain.reject = border(held_out[:, 1], toxic)
    chain.found = {}
    return chain


def _judged(chain: Chain, b: pa.RecordBatch, text: str) -> np.ndarray:
    hold("toxicity", chain.found.clear)
    parts = [chain.probabilities([chain.features(t) for t in b.slice(k, 1000).column(text).to_pylist()]) for k in range(0, len(b), 1000)]
    return np.concatenate([np.zeros((0, len(CATEGORIES))), *parts])


def judge(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with p_<category> for each category and is_toxic after its columns, which have other names."""
    made = [StructField(f"p_{c}", DoubleType()) for c in CATEGORIES]
    schema = StructType([*docs.schema.fields, *made, StructField("is_toxic", BooleanType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _judged(chain, b, "text")
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, j]) for j in range(len(CATEGORIES))), pa.array(p[:, 1] >= chain.reject)], names)

    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs that the chain does not call toxic, with all their columns as they are."""
    at = docs.columns.index("text")
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_judged(chain, b, f"c{at}")[:, 1] < chain.reject))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lead_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    judged = judge(docs, train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *(f"p_{c}" for c in CATEGORIES), "is_toxic")

"""The queries without an oracle that search, fold and sample: each against a plain version on a small table."""

import itertools

import numpy as np
import pytest

from lodestar.operators import metrics as met
from lodestar.operators import selection as sel

ENTITIES = "patient_id long, total long, positive long"


def people(n, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), int(t), int(min(t, rng.integers(0, 6) * (i % 3 == 0)))) for i, t in enumerate(rng.integers(5, 40, n))]


def loss_of(split, rows, ratio):
    total, positive = {}, {}
    for (_, n, p), s in zip(rows, split, strict=True):
        total[s] = total.get(s, 0) + n
        positive[s] = positive.get(s, 0) + p
    both = all(0 < positive[s] < total[s] for s in total)
    return sum(abs(positive[s] / total[s] - ratio) for s in total) + (0 if both else 10)


def test_search_takes_the_best_trial(spark):
    rows, quota = people(30, 1), {"TEST": 6, "VALIDATION": 6}
    got = sel.search_split(spark.createDataFrame(rows, ENTITIES), "patient_id", 0.065, quota, 7, 11).collect()
    trials = []
    for t in range(7):
        order = [rows[i] for i in np.random.default_rng([11, t]).permutation(len(rows))]
        split = sel.allocate([r[1] for r in order], [r[2] for r in order], 0.065, quota)
        trials.append((loss_of(split, order, 0.065), t, {r[0]: s for r, s in zip(order, split, strict=True)}))
    loss, trial, split = min(trials, key=lambda x: x[:2])
    assert {r["patient_id"]: r["split"] for r in got} == split
    assert {r["trial"] for r in got} == {trial} and all(abs(r["loss"] - loss) < 1e-9 for r in got)
    assert len(got) == 30


def test_search_of_none_and_of_too_many(spark, monkeypatch):
    none = spark.createDataFrame([], ENTITIES)
    assert sel.search_split(none, "patient_id", 0.1, {"TEST": 0, "VALIDATION": 0}, 3, 1).count() == 0
    monkeypatch.setattr(sel, "ENTITIES", 3)
    with pytest.raises(ValueError):
        sel.search_split(spark.createDataFrame(people(4, 2), ENTITIES), "patient_id", 0.1, {"TEST": 1, "VALIDATION": 1}, 3, 1)


@pytest.mark.parametrize("wanted, positives, folds", [(5, 12, 5), (5, 3, 3), (4, 1, 2)])
def test_folds_are_whole_backed_off_and_even(spark, wanted, positives, folds):
    rows = [(i, 10 + i % 4, 3 if i < positives else 0) for i in range(24)]
    got = {r["patient_id"]: r["fold"] for r in sel.group_folds(spark.createDataFrame(rows, ENTITIES), "patient_id", wanted).collect()}
    assert sorted(got) == list(range(24)) and set(got.values()) == set(range(folds))
    load = [sum(p for i, _, p in rows if got[i] == k) for k in range(folds)]
    size = [sum(n for i, n, _ in rows if got[i] == k) for k in range(folds)]
    assert max(load) - min(load) <= 3 and max(size) <= 2 * min(size)


def kept_by_definition(points, tolerance, patience):
    curve = [np.mean([min(np.linalg.norm(p - q) for q in points[: k + 1]) for p in points]) for k in range(len(points))]
    small = [a <= 0 or (a - b) / a < tolerance for a, b in itertools.pairwise(curve)]
    for k in range(patience - 1, len(small)):
        if all(small[k - patience + 1 : k + 1]):
            return k + 2
    return len(points)


def test_adaptive_sample_of_whole_entities(spark):
    rng = np.random.default_rng(4)
    rows = [(e, i, [float(x) for x in rng.normal(size=3) * (0.01 if e == 1 and i % 5 else 1)]) for e, n in ((1, 60), (2, 40), (3, 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "e long, i long, v array<double>").repartition(3)
    got = sel.select_adaptive(frame, "e", "i", "v", 0.05, 3).collect()
    for e in (1, 2, 3):
        points = np.array([v for x, _, v in rows if x == e])
        assert sorted(r["i"] for r in got if r["e"] == e) == list(range(kept_by_definition(points, 0.05, 3)))


def test_adaptive_sample_sees_every_point(spark):
    n = 5000  # far points come last: the curve of the first thousands alone is flat
    rows = [(1, i, [0.0 if i < n - 2 else float(i)]) for i in range(n)]
    frame = spark.createDataFrame(rows, "e long, i long, v array<double>")
    assert sel.select_adaptive(frame, "e", "i", "v", 0.001, n).count() == n


def test_bootstrap_of_named_entities_repeats(spark):
    rows = [(f"p{i}", 5 + i, i % 3, i % 4, 9) for i in range(25)]
    made = spark.createDataFrame(rows, "p string, tp long, fp long, fn long, tn long")
    once, again = (sorted(map(tuple, met.bootstrap(made.repartition(k, "p"), "p", 50, 3).collect())) for k in (1, 4))
    assert [x[0] for x in once] == [x[0] for x in again]
    assert np.allclose([x[1:] for x in once], [x[1:] for x in again])

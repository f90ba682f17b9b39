"""Literal cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import arrays as arr
from lodestar.functions import geometry as geo
from lodestar.functions import references as ref
from lodestar.functions import text as txt
from lodestar.operators import metrics as met
from lodestar.operators import quality
from lodestar.operators import relational as rel
from lodestar.operators import selection as sel
from lodestar.operators import state as st

ROWS = "patient_id long, label int"


def one(df):
    return df.collect()[0].asDict()


def test_entity_table(spark):
    t = {r["patient_id"]: r for r in rel.entity_table(spark.createDataFrame([(2, 0), (1, 0), (1, 1), (2, 0)], ROWS), "patient_id", "label").collect()}
    assert (t[1].total, t[1].positive, t[1].negative, t[1].label) == (2, 1, 1, 1)
    assert (t[2].total, t[2].positive, t[2].negative, t[2].label) == (2, 0, 2, 0)


def test_global_ratio(spark):
    assert one(rel.global_ratio(spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (5, 1)], ROWS), "label"))["ratio"] == 0.6
    assert one(rel.global_ratio(spark.createDataFrame([], ROWS), "label"))["ratio"] is None


@pytest.mark.parametrize(
    ("rows", "quota", "want"),
    [
        ([(4, 4), (4, 0), (4, 2), (4, 2), (4, 2)], (1, 1), ["TEST", "VALIDATION", "TRAIN", "TRAIN", "TRAIN"]),
        ([(2, 1), (2, 1), (2, 1)], (1, 1), ["TEST", "VALIDATION", "TRAIN"]),
        ([(10, 9), (10, 9), (10, 5), (10, 5)], (1, 2), ["TEST", "VALIDATION", "VALIDATION", "TRAIN"]),
    ],
)
def test_greedy_allocation(rows, quota, want):
    assert sel.allocate([r[0] for r in rows], [r[1] for r in rows], 0.5, {"TEST": quota[0], "VALIDATION": quota[1]}) == want


def test_split_statistics_of_one_row_an_entity(spark):
    df = spark.createDataFrame([("TRAIN", 2, 0), ("TRAIN", 1, 1)], "split string, patient_id long, label int")
    r = one(rel.split_statistics(df, "split", "patient_id", "label"))
    assert (r["n_patients"], r["n_pos_patients"], r["n_neg_patients"], r["mean"], r["std"], r["q1"]) == (2, 1, 1, 1.0, 0.0, 1.0)
    mixed = spark.createDataFrame([("TRAIN", 1, 1), ("TRAIN", 1, 0), ("TRAIN", 2, 0)], "split string, patient_id long, label int")
    assert one(rel.split_statistics(mixed, "split", "patient_id", "label"))["n_pos_patients"] == 1


def rates(spark, tp, fp, fn, tn):
    df = spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long")
    return one(df.select(*(v.alias(k) for k, v in met.confusion_rates().items())))


def test_confusion_rates(spark):
    r = rates(spark, 4, 1, 3, 2)
    want = {"dice": 8 / 12, "iou": 0.5, "accuracy": 0.6, "tpr": 4 / 7, "tnr": 2 / 3, "precision": 0.8, "fpr": 1 / 3, "fnr": 3 / 7}
    assert all(abs(r[k] - v) < 1e-12 for k, v in want.items())
    r = rates(spark, 0, 0, 0, 0)
    assert r["dice"] == 1.0 and r["accuracy"] is None and r["tpr"] is None
    assert rates(spark, 0, 2, 0, 1)["dice"] == 0.0


def test_macro_summary(spark):
    df = spark.createDataFrame([(1, 2, 1, 1, 0), (2, 0, 0, 0, 4)], "patient_id long, tp long, fp long, fn long, tn long")
    r = one(met.macro(df, "patient_id"))
    assert abs(r["dice_pos_only"] - 2 / 3) < 1e-6 and r["neg_clean_rate"] == 1.0
    assert abs(one(met.micro(df))["dice"] - 2 / 3) < 1e-6
    assert met.bootstrap(df, "patient_id", 8, 1).count() == 0


def test_bootstrap_runs_from_twenty_entities(spark):
    df = spark.createDataFrame([(i, 5 + i % 3, i % 4, 2, 9) for i in range(20)], "patient_id long, tp long, fp long, fn long, tn long")
    rows = met.bootstrap(df, "patient_id", 200, 1).collect()
    assert {r.metric for r in rows} == {"micro_dice", "macro_dice"}
    assert all(0 < r.low < r.high < 1 for r in rows)
    assert sorted(rows) == sorted(met.bootstrap(df.repartition(3), "patient_id", 200, 1).collect())


def test_suppression(spark):
    df = spark.createDataFrame([(1, 2, 1, 3, 4), (2, 0, 2, 0, 7)], "patient_id long, tp long, fp long, fn long, tn long")
    p = spark.createDataFrame([(1, 1), (2, 0)], "patient_id long, k long")
    got = {r.patient_id: (r.tp, r.fp, r.fn, r.tn) for r in met.suppressed(df, "patient_id", p, "k", 2).collect()}
    assert got == {1: (0, 0, 5, 5), 2: (0, 0, 0, 9)}


def test_histogram_scores(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (0.8, 1), (0.2, 0)], "p double, truth int")
    assert one(met.histogram_auroc(df, "p", "truth", 8))["auroc"] == 1.0
    assert one(met.histogram_auprc(df, "p", "truth", 8))["auprc"] == 1.0
    assert one(met.best_mcc(df, "p", "truth", 8, [0.1, 0.5, 0.9]))["mcc"] == 1.0
    assert one(met.histogram_auroc(df.where("truth = 1"), "p", "truth", 8))["auroc"] is None
    assert met.collapse_guard(df.withColumn("p", F.lit(0.0)), "p", 0.3, 0.7).count() == 0
    assert one(met.exact_average_precision(df, "p", "truth"))["average_precision"] == 1.0


def test_components():
    p = np.array([[0.9, 0.9, 0, 0.9], [0.9, 0.9, 0, 0.9], [0, 0, 0, 0.9], [0.9, 0, 0, 0]])
    kept = arr.filter_components(p, 0.5, 4)
    assert kept.sum() == 4 and kept[:2, :2].all()
    assert not arr.filter_components(np.array([[1, 1], [0, 0.0]]), 0.5, 0, 0.75).any()
    assert arr.largest_component(p > 0.5) == 4
    assert arr.components(np.array([[1, 0], [0, 1]])).max() == 2  # no diagonals


def test_mask_labels(spark):
    df = spark.createDataFrame([(1, [1, 0, 0, 0]), (2, [1, 1, 0, 0]), (3, [0, 0, 0, 0])], "i int, m array<int>")
    assert [r.x for r in df.select("i", arr.mask_label(F.col("m"), 0.5).alias("x")).orderBy("i").collect()] == [False, True, False]
    assert [r.x for r in df.select("i", arr.mask_label(F.col("m"), 0).alias("x")).orderBy("i").collect()] == [True, True, False]
    c = spark.createDataFrame([([1, 1, 0, 0], [1, 0, 1, 0])], "p array<int>, t array<int>")
    assert one(c.select(*(v.alias(k) for k, v in arr.mask_confusion(F.col("p"), F.col("t")).items()))) == {"tp": 1, "fp": 1, "fn": 1, "tn": 1}


def test_weighted_vectors(spark):
    df = spark.createDataFrame([([65535, 65535], [0, 0])], "a array<int>, b array<int>")
    v = one(df.select(arr.weighted_sum([F.col("a"), F.col("b")], [0.75, 0.25]).alias("v")))["v"]
    assert all(abs(x - 0.75) < 1e-6 for x in v)


def test_selection_kernels():
    square = np.array([[0, 0], [0, 1], [1, 0], [1, 1.0]])
    assert np.allclose(sel.distances(square[:3]), [[0, 1, 1], [1, 0, 2**0.5], [1, 2**0.5, 0]])
    rng = np.random.default_rng(0)
    clumps = np.concatenate([c * 10 + rng.normal(size=(2, 2)) * 0.01 for c in square])
    chosen = sel.diverse_subset(clumps, 4)
    assert 1 <= len(set(chosen)) <= 4 and len({i // 2 for i in chosen}) == len(chosen)
    assert sel.diverse_subset(square[:2], 5) == [0, 1]
    curve = list(sel.coverage_curve(square, [0, 2, 1, 3]))
    for k in (2, 4):
        exact = np.min([[np.linalg.norm(p - square[i]) for i in [0, 2, 1, 3][:k]] for p in square], axis=1).mean()
        assert abs(curve[k - 1] - exact) < 1e-12
    assert sel.plateau([1.0, 0.5, 0.499, 0.4989, 0.4], 0.01, 2) == 4
    assert sel.early_stop([1.0, 1.2, 1.21, 1.22, 1.23], 0.1, 3) == 4
    assert sel.early_stop([1.0, 2.0, 3.0], 0.1, 1) == -1


def test_holdout_has_all_parts(spark):
    df = spark.createDataFrame([(i, int(i < 6)) for i in range(12)], "e long, label int")
    parts = sel.holdout(df, "e", "label", 1).groupBy("part").count().collect()
    assert {r["part"] for r in parts} == {"calibration", "holdout", "fit"} and sum(r["count"] for r in parts) == 12


def test_contracts(spark):
    q = lambda i, m: one(spark.createDataFrame([(i, m)], "i string, m string").select(ref.pair_is_valid(F.col("i"), F.col("m")).alias("x")))["x"]
    assert q("HDF5::images[7]", "HDF5::masks[7]") and q("", "") and q("/a::images[7]", "/a::masks[7]")
    assert not q("HDF5::images[7]", "HDF5::masks[8]") and not q("x.png", "HDF5::masks[8]") and not q("HDF5::images[7]", "")
    df = spark.createDataFrame([("PATIENT_999_PATCH_001.png",), ("other",)], "f string")
    assert [r.p for r in df.select(ref.patient_of(F.col("f")).alias("p")).collect()] == [999, None]
    p = spark.createDataFrame([("SOURCE::a/b",), ("SOURCE::../b",), ("SOURCE::/b",), ("SOURCE::C:/b",), ("MANIFEST::",), ("/abs",), ("SOURCE::a\\b",)], "r string")
    assert [r.x for r in p.select(ref.is_portable(F.col("r")).alias("x")).collect()] == [True, False, False, False, False, False, False]


def test_text(spark):
    df = spark.createDataFrame([("10.1038_s41467-024-54769-y", "A&B_50% #1", "x\n## References\ndoi: 10.1/zz")], "stem string, t string, body string")
    doi = txt.doi_of(F.col("body"), F.col("stem"))
    r = one(df.select(doi.alias("doi"), txt.bib_key(doi, F.col("stem")).alias("key"), txt.latex_escaped(F.col("t")).alias("tex"), txt.year_of(F.col("body"), doi).alias("year")))
    assert r["doi"] == "10.1038/s41467-024-54769-y" and r["key"] == "sysrev_10_1038_s41467_024_54769_y"
    assert r["tex"] == "A\\&B\\_50\\% \\#1" and r["year"] == "2024"
    assert one(spark.createDataFrame([("a\\b{",)], "t string").select(txt.latex_escaped(F.col("t")).alias("x")))["x"] == "a\\textbackslash{}b\\{"


def test_geometry(spark):
    triangle = np.array([[0, 0], [4, 0], [0, 4.0]])
    assert geo.area(triangle) == 8 and geo.contains(triangle, 1, 1) and not geo.contains(triangle, 3, 3)
    assert abs(geo.coverage(triangle, 0, 0, 2) - 1) < 1e-12 and abs(geo.coverage(triangle, 2, 0, 2) - 0.5) < 1e-12
    assert geo.nm_to_pixels(500, 0, 250, 100) == 52


def test_state(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d")], "k long, v string")
    assert sorted(map(tuple, st.replace_by_key(old, new, "k").collect())) == [(1, "a"), (2, "c"), (2, "d")]
    changes = spark.createDataFrame([(1, None), (2, "z")], "k long, v string")
    assert sorted(map(tuple, st.update_by_key(old, changes, "k", ["v"]).collect())) == [(1, "a"), (2, "z")]
    queue = spark.createDataFrame([("m1", "s1", "DONE"), ("m2", "s2", "DONE"), ("m3", "s3", "FAILED")], "name string, sig string, status string")
    members = spark.createDataFrame([("m1", "old", 0), ("m1", "s1", 1), ("m2", "new", 0), ("m4", "s4", 0)], "name string, sig string, pos int")
    got = sorted(map(tuple, st.sync_queue(queue, members, "name", "sig", "pos").collect()))
    assert got == [("m1", "s1", "DONE"), ("m2", "new", "PENDING"), ("m3", "s3", "FAILED"), ("m4", "s4", "PENDING")]
    assert st.all_or_nothing(old, new, 2, "k") is old and st.all_or_nothing(old, changes, 2, "k") is changes


def test_two_phase_lookup(spark):
    index = spark.createDataFrame([("MANIFEST::a/PATCHES/x.h5", 1), ("MANIFEST::b/PATCHES/y.h5", 2), ("MANIFEST::c/PATCHES/y.h5", 3)], "path string, target long")
    records = spark.createDataFrame([("MANIFEST::a/PATCHES/x.h5",), ("/mnt/PATCHES/x.h5",), ("/mnt/PATCHES/y.h5",), ("/none/z",)], "path string")
    got = {r.path: (r.target, r.how) for r in quality.two_phase_lookup(records, index, "path", "target").collect()}
    assert got == {"MANIFEST::a/PATCHES/x.h5": (1, "exact"), "/mnt/PATCHES/x.h5": (1, "portable"), "/mnt/PATCHES/y.h5": (None, "ambiguous"), "/none/z": (None, "missing")}


def test_entropy_and_otsu(spark):
    counts = spark.createDataFrame([(1, 5), (1, 5), (2, 9)], "k long, n long")
    assert {r.k: r.entropy for r in arr.entropy(counts, "k").collect()} == {1: 1.0, 2: 0.0}
    assert 10 <= arr.otsu(np.array([10] * 50 + [200] * 50)) < 200
    stains = np.array([[0.65, 0.7, 0.29], [0.07, 0.99, 0.11]])
    amounts = arr.stain_concentrations(np.clip(256 * np.exp(-np.array([[0.5, 0.2]]) @ stains) - 1, 0, 255), stains)
    assert np.allclose(amounts, [[0.5, 0.2]], atol=1e-6)


def test_rings_and_tissue():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4.0]])
    assert geo.rings_overlap(square, square + 2) and geo.rings_overlap(square, square / 4 + 1) and geo.rings_overlap(square, square)
    assert not geo.rings_overlap(square, square + 4) and not geo.rings_overlap(square, square + [4, 0])  # a shared edge has no area
    star = np.array([[0, 0], [10, 0], [10, 10], [5, 1], [0, 10.0]])
    assert not geo.rings_overlap(star, np.array([[4, 6], [6, 6], [6, 9], [4, 9.0]]))  # inside the box, outside the ring
    image = np.full((20, 20, 3), 250, np.uint8)
    image[5:15, 5:15] = (200, 60, 120)
    image[9, 9] = 250
    image[1, 1] = (200, 60, 120)
    mask = arr.tissue_mask(image)
    assert mask[5:15, 5:15].all() and not mask[1, 1] and mask.sum() == 100


def test_unambiguous_meets_distinct_boxes_alone(spark):
    rows = [(k, float(k % 3 * 10), 0.0, float(k % 3 * 10 + 8), 8.0) for k in range(300)] + [(900, None, 0.0, 5.0, 5.0)]
    others = [(k, 7.0, 7.0, 12.0, 9.0) for k in range(300)] + [(901, 28.0, 0.0, 30.0, 8.0)]  # the last shares an edge alone
    make = lambda r: spark.createDataFrame(r, "box long, x0 double, y0 double, x1 double, y1 double")
    got = quality.unambiguous(make(rows), make(others), 64)
    assert sorted(x.box for x in got.collect()) == [*range(2, 300, 3), 900]
    # Copies are one row on either side of the grid join: it is a semi join, and pairs are never made.
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()


def test_copies_of_polygons_are_compared_once(spark):
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    tri = [(0.0, 0.0), (6.0, 0.0), (0.0, 6.0)]
    left = [(k, ring(0.0, 0.0, 4.0)) for k in range(90)] + [(1000, tri), (1001, ring(50.0, 50.0, 9.0)), (None, ring(0.0, 0.0, 4.0)), (1002, None)]
    right = [(k, ring(3.0, 3.0, 4.0)) for k in range(80)] + [(2000, tri), (2001, ring(4.0, 0.0, 4.0)), (2002, ring(52.0, 52.0, 1.0))]
    make = lambda rows, k: spark.createDataFrame(rows, f"{k} long, ring array<struct<x: double, y: double>>")
    got = [(x.l, x.r) for x in geo.overlapping_polygons(make(left, "l"), make(right, "r"), 8.0).collect()]
    want = [(i, j) for i, a in left for j, b in right if a and geo.rings_overlap(np.array(a), np.array(b))]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 91 * 80
    shaped = geo.shaped(make(left, "l"), ["ring"])
    assert geo.shapes(shaped, ["ring"]).count() == 4
    held = [len(x.l) for x in geo.members(shaped, "l", 20).collect()]
    assert sum(held) == len(left) and max(held) < 60


def test_all_rings_overlap():
    r = np.random.default_rng(5)
    angle = np.sort(r.random((400, 7)) * 2 * np.pi, axis=1)
    rings = np.stack([np.cos(angle), np.sin(angle)], axis=-1) * r.uniform(0.2, 2, (400, 1, 1)) + r.uniform(-2, 2, (400, 1, 2))
    a, b = rings[:200], rings[200:, :5]
    got = geo.all_rings_overlap(a, b)
    assert 20 < got.sum() < 180
    for x, y, hit in zip(a, b, got, strict=True):
        # By sampling points: what shares a clear area overlaps, and what shares none of many points hardly does.
        points = r.uniform(-4, 4, (400, 2))
        both = any(geo.contains(x, *p) and geo.contains(y, *p) for p in points)
        assert hit or not both


def test_copies_of_windows_and_boxes_meet_as_shapes(spark):
    w = [(k, 10.0 * (k % 2), 0.0) for k in range(400)]
    b = [(k, 12.0, 3.0, 20.0, 9.0) for k in range(300)] + [(900, 8.0, 0.0, 10.0, 2.0), (None, 0.0, 0.0, 1.0, 1.0), (901, None, 0.0, 1.0, 1.0)]
    windows = spark.createDataFrame(w, "window long, x double, y double")
    boxes = spark.createDataFrame(b, "box long, x0 double, y0 double, x1 double, y1 double")
    joined = geo.windows_on_boxes(windows, boxes, 10, 16)
    got = sorted(map(str, ((x.window, x.box, x.area) for x in joined.collect())))
    want = []
    for i, x, y in w:
        for j, x0, y0, x1, y1 in b:
            if x0 is not None and x < x1 and x0 < x + 10 and y < y1 and y0 < y + 10:
                want.append(str((i, j, (min(x + 10, x1) - max(x, x0)) * (min(y + 10, y1) - max(y, y0)))))
    assert got == sorted(want)
    # Ids take their places after the join, so the grid join has no more rows than shapes and cells.
    assert "explode(window" in joined._jdf.queryExecution().executedPlan().toString()

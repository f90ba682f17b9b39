"""Queries: metrics, calibration, sampling, selection, checks, text, references and arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import arrays as arr
from lodestar.functions import geometry, hashing
from lodestar.functions import references as ref
from lodestar.functions import text as txt
from lodestar.operators import metrics as met
from lodestar.operators import objectives
from lodestar.operators import quality
from lodestar.operators import selection as sel
from lodestar.operators.relational import positions
from lodestar.plans.base import confusion, indexed, patches, query, rates, read, scored, state

RATES = """CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END ELSE 2.0 * tp / (2 * tp + fp + fn) END::DOUBLE AS dice,
  CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END ELSE tp::DOUBLE / (tp + fp + fn) END::DOUBLE AS iou,
  (tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS accuracy, tp::DOUBLE / nullif(tp + fn, 0) AS tpr, tn::DOUBLE / nullif(tn + fp, 0) AS tnr,
  tp::DOUBLE / nullif(tp + fp, 0) AS precision, fp::DOUBLE / nullif(fp + tn, 0) AS fpr, fn::DOUBLE / nullif(fn + tp, 0) AS fnr"""
RATE_NAMES = ("dice", "iou", "accuracy", "tpr", "tnr", "precision", "fpr", "fnr")
ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in RATE_NAMES)
SUMMED = "SELECT patient_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM confusion GROUP BY 1"

# Metrics


@query("f17_confusion_rates", f"SELECT patch_id, {ROUNDED} FROM (SELECT patch_id, {RATES} FROM confusion)", "confusion")
def f17(spark, d):
    return confusion(spark, d).select("patch_id", *(v.alias(k) for k, v in met.confusion_rates(6).items()))


@query("f18_calibration_rates", "SELECT patch_id, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END::DOUBLE, 6) AS dice, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0), 6) AS tpr FROM confusion", "confusion")
def f18(spark, d):
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return confusion(spark, d).select("patch_id", F.round(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(1.0)), 6).alias("dice"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)), 6).alias("tpr"))


@query("c13_micro_summary", f"SELECT tp, fp, fn, tn, {ROUNDED} FROM (SELECT tp, fp, fn, tn, {RATES} FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM confusion))", "confusion")
def c13_micro(spark, d):
    return met.micro(confusion(spark, d))


@query("c13_macro_summary", f"SELECT count(*) AS n_patients, {', '.join(f'round(avg({n}), 6) AS {n}' for n in RATE_NAMES)}, round(avg(dice) FILTER (tp + fn > 0), 6) AS dice_pos_only, round(avg(CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END) FILTER (tp + fn = 0), 6) AS neg_clean_rate, count(*) FILTER (tp + fn > 0) AS n_pos_patients, count(*) FILTER (tp + fn = 0) AS n_neg_patients FROM (SELECT tp, fp, fn, tn, {RATES} FROM confusion)", "confusion")
def c13_macro(spark, d):
    return met.macro(confusion(spark, d), "patch_id")


@query("c14_patient_suppression", f"SELECT patient_id, CASE WHEN k < 60 THEN 0 ELSE tp END AS tp, CASE WHEN k < 60 THEN 0 ELSE fp END AS fp, CASE WHEN k < 60 THEN tp + fn ELSE fn END AS fn, CASE WHEN k < 60 THEN fp + tn ELSE tn END AS tn, k < 60 AS suppressed FROM ({SUMMED}) JOIN (SELECT patient_id, count(*) FILTER (tp + fp > 0) AS k FROM confusion GROUP BY 1) USING (patient_id)", "confusion")
def c14(spark, d):
    c = confusion(spark, d)
    hits = c.groupBy("patient_id").agg(F.count_if(F.col("tp") + F.col("fp") > 0).alias("k"))
    return met.suppressed(c, "patient_id", hits, "k", 60)


@query("c15_patient_diagnostics", f"SELECT patient_id, tp, fp, fn, tn, {ROUNDED} FROM (SELECT patient_id, tp, fp, fn, tn, {RATES} FROM ({SUMMED}))", "confusion")
def c15(spark, d):
    p = met.per_entity(confusion(spark, d), "patient_id")
    return p.select("patient_id", *met.COUNTS, *(F.round(k, 6).alias(k) for k in RATE_NAMES))


@query("c16_metric_accumulator", "SELECT user_id, count(*) AS n, count(*) FILTER (truth = 1) AS positives, count(*) FILTER (p >= 0.5) AS predicted, count(*) FILTER (p >= 0.5 AND truth = 1) AS tp, max(CAST(trunc(p * 4095) AS INTEGER)) AS top_bin FROM scored GROUP BY 1", "scored")
def c16(spark, d):
    hit, yes = F.col("p") >= 0.5, F.col("truth") == 1
    return scored(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(yes).alias("positives"), F.count_if(hit).alias("predicted"), F.count_if(hit & yes).alias("tp"), F.max(F.floor(F.col("p") * 4095).cast("int")).alias("top_bin"))


@query("c17_collapse_guard", "SELECT avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS prevalence FROM scored HAVING avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) BETWEEN 0.001 AND 0.99", "scored")
def c17(spark, d):
    return met.collapse_guard(scored(spark, d), "p", 0.001, 0.99)


CUM = """h AS (SELECT b.bin, count(*) FILTER (s.truth = 1) AS p, count(*) FILTER (s.truth = 0) AS q FROM (SELECT unnest(range(64)) AS bin) b LEFT JOIN (SELECT truth, least(CAST(floor(p * 64) AS INTEGER), 63) AS bin FROM scored) s USING (bin) GROUP BY 1),
  cum AS (SELECT bin, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM h WINDOW w AS (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("w02_reverse_cumulative", f"WITH {CUM} SELECT bin::INTEGER AS bin, tp::BIGINT AS tp, fp::BIGINT AS fp FROM cum", "scored")
def w02(spark, d):
    return met.at_or_above(scored(spark, d), "p", "truth", 64)


@query("w03_histogram_auroc", f"WITH {CUM} SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auroc FROM (SELECT fpr, tpr, lag(fpr, 1, 0.0) OVER (ORDER BY bin DESC) AS f0, lag(tpr, 1, 0.0) OVER (ORDER BY bin DESC) AS t0 FROM (SELECT bin, tp::DOUBLE / max(tp) OVER () AS tpr, fp::DOUBLE / max(fp) OVER () AS fpr FROM cum))", "scored")
def w03(spark, d):
    return met.histogram_auroc(scored(spark, d), "p", "truth", 64)


@query("w04_histogram_auprc", f"WITH {CUM} SELECT round(sum((r - r0) * p), 6) AS auprc FROM (SELECT r, lag(r, 1, 0.0) OVER (ORDER BY bin DESC) AS r0, p FROM (SELECT bin, tp::DOUBLE / greatest(max(tp) OVER (), 1) AS r, tp::DOUBLE / greatest(tp + fp, 1) AS p FROM cum))", "scored")
def w04(spark, d):
    return met.histogram_auprc(scored(spark, d), "p", "truth", 64)


@query("w05_best_mcc", f"WITH {CUM}, m AS (SELECT t.threshold, c.tp::DOUBLE AS tp, c.fp::DOUBLE AS fp, (x.P - c.tp)::DOUBLE AS fn, (x.N - c.fp)::DOUBLE AS tn FROM (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold) t JOIN cum c ON c.bin = CAST(floor(t.threshold * 64) AS INTEGER) CROSS JOIN (SELECT max(tp) AS P, max(fp) AS N FROM cum) x) SELECT mcc, threshold FROM (SELECT round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0), 6) AS mcc, threshold FROM m) ORDER BY mcc DESC, threshold LIMIT 1", "scored")
def w05(spark, d):
    return met.best_mcc(scored(spark, d), "p", "truth", 64, [k / 10 for k in range(1, 10)])


SMOOTH = "sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5"


def _smooth():
    """Of each user's curve of values."""
    return F.sum("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 2)) / 5


@query("w06_moving_average", f"SELECT user_id, event_id, round({SMOOTH}, 4) AS smooth FROM events")
def w06(spark, d):
    return read(spark, d, "events").select("user_id", "event_id", F.round(_smooth(), 4).alias("smooth"))


@query("w07_curve_minimum", f"SELECT user_id, event_id, smooth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY smooth, event_id) AS place FROM (SELECT user_id, event_id, round({SMOOTH}, 4) AS smooth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn > 5 AND rn <= n - 5)) WHERE place = 1")
def w07(spark, d):
    own = Window.partitionBy("user_id")
    t = read(spark, d, "events").select("user_id", "event_id", "value").withColumn("rn", F.row_number().over(own.orderBy("event_id"))).withColumn("n", F.count("*").over(own)).where("rn > 5 and rn <= n - 5")
    s = t.select("user_id", "event_id", F.round(_smooth(), 4).alias("smooth"))
    return s.groupBy("user_id").agg(F.min(F.struct("smooth", "event_id")).alias("m")).select("user_id", "m.event_id", "m.smooth")


@query("w08_plateau")
def w08(spark, d):
    kept = lambda f: pd.DataFrame({"label": f["label"].iloc[:1], "kept": [sel.plateau(sel.coverage_curve(np.stack(f.sort_values("vec_id")["embedding"]).astype(float), range(len(f))), 0.004, 3)]})
    return read(spark, d, "embeddings").groupBy("label").applyInPandas(kept, "label int, kept long")


@query("w09_early_stop")
def w09(spark, d):
    stop = lambda f: pd.DataFrame({"user_id": f["user_id"].iloc[:1], "stop": [sel.early_stop(f.sort_values("event_id")["value"].tolist(), 5.0, 6)]})
    return read(spark, d, "events").select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(stop, "user_id long, stop long")


@query("w15_smoothed_stop", """WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id, value FROM events),
  e AS (SELECT user_id, k, event_id, value AS ema, value AS low FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, r.event_id, 0.05 * r.value + 0.95 * e.ema, least(e.low, 0.05 * r.value + 0.95 * e.ema) FROM e JOIN r ON r.user_id = e.user_id AND r.k = e.k + 1),
  f AS (SELECT user_id, min(k) FILTER (ema > 1.5 * low) AS first FROM e GROUP BY 1)
  SELECT user_id, event_id, round(ema + 1e-9, 4) AS ema FROM e JOIN f USING (user_id) WHERE k <= coalesce(first, 1000000000)""")
def w15(spark, d):
    seq = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("c"))  # one curve a user
    start = F.array().cast("array<struct<event_id:bigint,ema:double,low:double>>")

    def step(done, x):
        last = F.element_at(done, -1)
        ema = F.when(F.size(done) == 0, x["value"]).otherwise(F.lit(0.05) * x["value"] + F.lit(0.95) * last["ema"])
        low = F.when(F.size(done) == 0, ema).otherwise(F.least(last["low"], ema))
        return F.concat(done, F.array(F.struct(x["event_id"].alias("event_id"), ema.alias("ema"), low.alias("low"))))

    e = seq.select("user_id", F.posexplode(F.aggregate("c", start, step)).alias("k", "x")).select("user_id", "k", "x.*")
    past = F.min(F.when(F.expr("ema > 1.5 * low"), F.col("k"))).over(Window.partitionBy("user_id"))
    return e.withColumn("first", past).where("k <= coalesce(first, 1000000000)").select("user_id", "event_id", F.round(F.col("ema") + 1e-9, 4).alias("ema"))  # no ties


@query("c12_bootstrap")
def c12(spark, d):
    return met.bootstrap(confusion(spark, d), "patient_id", 1000, 7)


FACTS = """facts AS (SELECT t.i, l_suppkey AS patient_id, count(*) FILTER (l_discount > t.th AND truth) AS tp, count(*) FILTER (l_discount > t.th AND NOT truth) AS fp, count(*) FILTER (l_discount <= t.th AND truth) AS fn, count(*) FILTER (l_discount <= t.th AND NOT truth) AS tn
  FROM (SELECT l_suppkey, l_discount, l_returnflag = 'R' AND l_suppkey % 2 = 0 AND l_linenumber = 1 AS truth FROM lineitem) CROSS JOIN (SELECT unnest(range(10)) AS i, unnest([0.005, 0.015, 0.025, 0.035, 0.045, 0.055, 0.065, 0.075, 0.085, 0.095]::DOUBLE[]) AS th) t GROUP BY 1, 2),
  scores AS (SELECT i, round(coalesce(avg(CASE WHEN tp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 0.0), 6) AS positive_dice, round(coalesce(avg(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END), 0.0), 6) AS positive_tpr,
  round(coalesce(avg(CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0::DOUBLE ELSE 0.0 END END), 0.0), 6) AS negative_clean_rate, round(coalesce(avg(tp::DOUBLE / nullif(tp + fp, 0)), 0.0), 6) AS macro_precision,
  round((coalesce(sum(CASE WHEN tp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 0.0) + coalesce(sum(CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0::DOUBLE ELSE 0.0 END END), 0.0)) / count(*), 6) AS macro_score,
  round(coalesce(2.0::DOUBLE * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0.0), 6) AS micro_dice FROM facts GROUP BY 1)"""


def _facts(spark, d):
    """Each line item is counted once by how many thresholds lie below its score; candidates are joined to those counts."""
    truth = (F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 2 == 0) & (F.col("l_linenumber") == 1)
    k = F.lit(0)
    for i in range(10):
        k = k + (F.col("l_discount") > i / 100 + 0.005).cast("int")
    n = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("patient_id"), k.alias("k"), truth.alias("t")).groupBy("patient_id", "k").agg(F.count_if("t").alias("p"), F.count_if(~F.col("t")).alias("q"))
    c = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9))))
    over = F.col("k") > F.col("i")
    part = lambda on, c: F.sum(F.when(on, F.col(c)).otherwise(0)).cast("long")
    return c.groupBy(F.col("i").cast("long").alias("i"), "patient_id").agg(part(over, "p").alias("tp"), part(over, "q").alias("fp"), part(~over, "p").alias("fn"), part(~over, "q").alias("tn"))


@query("c18_calibration_grid", f"WITH {FACTS} SELECT i, patient_id, tp, fp, fn, tn FROM facts")
def c18(spark, d):
    return _facts(spark, d)


@query("c19_candidate_scores", f"WITH {FACTS} SELECT * FROM scores")
def c19(spark, d):
    return met.grid_scores(_facts(spark, d), "patient_id")


GUARD = {"positive_dice": 0.01, "positive_tpr": 0.2, "micro_dice": 0.01, "negative_clean_rate": 0.9, "macro_precision": 0.01, "macro_tpr": 0.2}


@query("c20_guardrail_selection", f"""WITH {FACTS}, t AS (SELECT *, positive_dice >= 0.01 AND positive_tpr >= 0.2 AS a, micro_dice >= 0.01 AS b, negative_clean_rate >= 0.9 AND macro_precision >= 0.01 AND positive_tpr >= 0.2 AS c FROM scores),
  u AS (SELECT *, CASE WHEN a AND b AND c THEN 3 WHEN a AND b THEN 2 WHEN a THEN 1 ELSE 0 END AS tier FROM t)
  SELECT i, ['positive_guardrail_infeasible', 'micro_guardrail_infeasible', 'target_infeasible', 'target_met'][tier + 1] AS status, macro_score, (SELECT count(*) FROM u WHERE a) AS n_positive, (SELECT count(*) FROM u WHERE a AND b) AS n_micro, (SELECT count(*) FROM u WHERE a AND b AND c) AS n_target
  FROM u ORDER BY tier DESC, macro_score DESC, negative_clean_rate DESC, positive_tpr DESC, positive_dice DESC, micro_dice DESC, macro_precision DESC, i LIMIT 1""")
def c20(spark, d):
    return met.select_candidate(met.grid_scores(_facts(spark, d), "patient_id"), "i", GUARD)


@query("c22_exact_average_precision", "SELECT round(sum(p * cp::DOUBLE / cn) / sum(p), 6) AS average_precision FROM (SELECT p, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM (SELECT p AS s, sum(truth) AS p, count(*) AS n FROM scored GROUP BY 1))", "scored")
def c22(spark, d):
    return met.exact_average_precision(scored(spark, d), "p", "truth")


TRIALS = "SELECT unnest([0, 1, 2]) AS trial, unnest([0.02, 0.05, 0.2]::DOUBLE[]) AS th"


@query("c21_region_objective", f"""WITH f AS (SELECT trial, patient_id, count(*) FILTER (l_discount > th AND truth) AS hit, count(*) FILTER (l_discount > th) AS region, count(*) FILTER (truth) AS truth, count(*) AS size
  FROM (SELECT l_suppkey AS patient_id, l_discount, l_returnflag = 'R' AND l_suppkey % 2 = 0 AS truth FROM lineitem) CROSS JOIN ({TRIALS}) GROUP BY 1, 2),
  t AS (SELECT trial, coalesce(avg(CASE WHEN truth > 0 THEN hit / (truth + 1e-7::DOUBLE) END), 0.0) AS recall, coalesce(avg(CASE WHEN truth = 0 THEN region / size::DOUBLE END), 0.0) AS negative, avg(CASE WHEN region = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS empty, median(region / size::DOUBLE) AS med, avg(truth / size::DOUBLE) AS density FROM f GROUP BY 1),
  s AS (SELECT *, CASE WHEN empty > 0.2 THEN 'empty' WHEN recall < 0.3 THEN 'misses' WHEN med > greatest(0.6, density + 0.15) THEN 'permissive' ELSE 'ok' END AS status FROM t)
  SELECT trial, status, CASE WHEN status = 'ok' THEN round(recall - 0.1 * negative, 6) END AS objective FROM s""")
def c21(spark, d):
    """Three trials: each patient's line items are counted once under all thresholds."""
    truth = (F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 2 == 0)
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("patient_id"), "l_discount", truth.alias("t"))
    ths = [0.02, 0.05, 0.2]
    over = lambda th: F.col("l_discount") > th
    each = [F.struct(F.lit(i).alias("trial"), F.count_if(over(th) & F.col("t")).alias("hit"), F.count_if(over(th)).alias("region")) for i, th in enumerate(ths)]
    g = li.groupBy("patient_id").agg(F.count_if("t").alias("truth"), F.count("*").alias("size"), F.array(*each).alias("trials"))
    facts = g.select("patient_id", "truth", "size", F.explode("trials").alias("x")).select("patient_id", "truth", "size", "x.*")
    return objectives.region_objective(facts, "trial", {"empty": 0.2, "recall": 0.3, "median": 0.6, "penalty": 0.1})


@query("c22_spatial_objective", """SELECT trial, round(coalesce(avg(CASE WHEN positive THEN ap END), 0.0) - 0.2 * avg(outside / (mass + 1e-7)) - 0.1 * coalesce(avg(CASE WHEN NOT positive THEN mean END), 0.0), 6) AS objective
  FROM (SELECT user_id % 3 AS trial, user_id, sum(truth) > 12 AS positive, avg(CASE WHEN truth = 1 THEN p END) AS ap, sum(CASE WHEN truth = 0 THEN p ELSE 0 END) AS outside, sum(p) AS mass, avg(p) AS mean FROM scored GROUP BY 1, 2) GROUP BY 1""", "scored")
def c22_spatial(spark, d):
    s = scored(spark, d)
    yes = F.col("truth") == 1
    facts = s.groupBy((F.col("user_id") % 3).alias("trial"), "user_id").agg((F.sum("truth") > 12).alias("positive"), F.avg(F.when(yes, F.col("p"))).alias("ap"), F.sum(F.when(~yes, F.col("p")).otherwise(0.0)).alias("outside"), F.sum("p").alias("mass"), F.avg("p").alias("mean"))
    return objectives.spatial_objective(facts, "trial", 0.2, 0.1)


@query("c42_recipe", """SELECT p_partkey, role, weight, row_number() OVER (ORDER BY CASE role WHEN 'semantic' THEN 0 WHEN 'spatial' THEN 1 ELSE 2 END, weight DESC, p_partkey) AS position
  FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'spatial' ELSE 'none' END AS role, CASE WHEN p_partkey % 3 = 2 THEN 0.0 ELSE p_size / 50.0::DOUBLE END AS weight FROM part)""")
def c42(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey") % 3
    weights = p.where("p_partkey % 3 <> 2").select("p_partkey", F.when(k == 0, "semantic").otherwise("spatial").alias("role"), (F.col("p_size") / 50.0).alias("weight"))
    return objectives.recipe(p.select("p_partkey"), "p_partkey", weights)


@query("j11_polygon_overlaps", 'SELECT a.box AS l, b.box AS r FROM (SELECT p_partkey AS box, (p_partkey * 37 % 900)::DOUBLE AS x0, (p_partkey * 53 % 900)::DOUBLE AS y0, p_size::DOUBLE AS s FROM part WHERE p_partkey % 2 = 0) a JOIN (SELECT p_partkey AS box, (p_partkey * 37 % 900)::DOUBLE AS x0, (p_partkey * 53 % 900)::DOUBLE AS y0, p_size::DOUBLE AS s FROM part WHERE p_partkey % 2 = 1) b ON a.x0 < b.x0 + b.s AND b.x0 < a.x0 + a.s AND a.y0 < b.y0 + b.s AND b.y0 < a.y0 + a.s')
def j11(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = (k * 37 % 900).cast("double"), (k * 53 % 900).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(point(x, y), point(x + s, y), point(x + s, y + s), point(x, y + s))
    p = read(spark, d, "part")
    return geometry.overlapping_polygons(p.where("p_partkey % 2 = 0").select(k.alias("l"), ring.alias("ring")), p.where("p_partkey % 2 = 1").select(k.alias("r"), ring.alias("ring")), 64.0)


@query("c23_threshold_by_f1", "SELECT threshold, f1 FROM (SELECT t.threshold, round(coalesce(2.0::DOUBLE * count(*) FILTER (p > threshold AND truth = 1) / nullif(2 * count(*) FILTER (p > threshold AND truth = 1) + count(*) FILTER (p > threshold AND truth = 0) + count(*) FILTER (p <= threshold AND truth = 1), 0), 0.0), 6) AS f1 FROM scored CROSS JOIN (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS threshold) t GROUP BY 1) ORDER BY f1 DESC, threshold LIMIT 1", "scored")
def c23(spark, d):
    return met.threshold_by_f1(scored(spark, d), "p", "truth", [round(0.05 * k, 2) for k in range(1, 20)])


@query("c26_adjusted_rand", """WITH c AS (SELECT label, CAST(floor(embedding[1] * 4) AS INTEGER) AS k, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2),
  x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY label)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY k)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)
  SELECT round(coalesce((ab - a * b / t) / nullif((a + b) / 2 - a * b / t, 0), 1.0), 6) AS ari FROM x""")
def c26(spark, d):
    e = read(spark, d, "embeddings").select("label", F.floor(F.col("embedding")[0] * 4).cast("int").alias("k"))
    return met.adjusted_rand(e, "label", "k")


@query("c43_loss_reductions", "SELECT user_id, round(avg(-(truth * ln(greatest(p, 1e-7)) + (1 - truth) * ln(greatest(1 - p, 1e-7)))), 6) AS bce, round(1 - (2 * sum(p * truth) + 1) / (sum(p) + sum(truth) + 1), 6) AS soft_dice FROM scored GROUP BY 1", "scored")
def c43(spark, d):
    p, t = F.col("p"), F.col("truth")
    bce = -(t * F.log(F.greatest(p, F.lit(1e-7))) + (1 - t) * F.log(F.greatest(1 - p, F.lit(1e-7))))
    return scored(spark, d).groupBy("user_id").agg(F.round(F.avg(bce), 6).alias("bce"), F.round(1 - (2 * F.sum(p * t) + 1) / (F.sum(p) + F.sum(t) + 1), 6).alias("soft_dice"))


# Splits, samples, subsets


def _entities(spark, d):
    return patches(spark, d).groupBy("patient_id").agg(F.count("*").alias("total"), F.sum("label").cast("long").alias("positive"))


@query("c01_greedy_split")
def c01(spark, d):
    e = _entities(spark, d)
    n = e.count()
    return sel.greedy_split(e, "patient_id", ["total"], 0.065, {"TEST": n // 5, "VALIDATION": n // 5})


@query("c02_trial_order", "SELECT patient_id, row_number() OVER (ORDER BY patient_id * 31 % 17, patient_id) AS position FROM (SELECT DISTINCT patient_id FROM patches)", "patches")
def c02(spark, d):
    e = patches(spark, d).select("patient_id").distinct().withColumn("weight", F.col("patient_id") * 31 % 17)
    return positions(e, ["weight", F.floor(F.col("patient_id") / 4096)], ["patient_id"], "position").select("patient_id", "position")


@query("c03_split_search")
def c03(spark, d):
    e = _entities(spark, d)
    n = e.count()
    return sel.search_split(e, "patient_id", 0.065, {"TEST": n // 5, "VALIDATION": n // 5}, 16, 11).select("patient_id", "split", F.round("loss", 9).alias("loss"))


@query("c04_row_assignment", "SELECT patch_id, CASE WHEN patient_id % 10 < 2 THEN 'TEST' WHEN patient_id % 10 < 4 THEN 'VALIDATION' ELSE 'TRAIN' END AS split FROM patches", "patches")
def c04(spark, d):
    p = patches(spark, d)
    k = F.col("patient_id") % 10
    split = p.select("patient_id").distinct().withColumn("split", F.when(k < 2, "TEST").when(k < 4, "VALIDATION").otherwise("TRAIN"))
    return p.join(split, "patient_id").select("patch_id", "split")


@query("c05_manifest_assembly", "SELECT 'run-1' AS run_id, split, label, patient_id, filename, row_number() OVER (PARTITION BY split, patient_id ORDER BY label, filename) - 1 AS row_index, 'images[' || CAST(row_number() OVER (PARTITION BY split, patient_id ORDER BY label, filename) - 1 AS VARCHAR) || ']' AS image_ref FROM patches JOIN state USING (patch_id) WHERE split IS NOT NULL", "patches state")
def c05(spark, d):
    j = patches(spark, d).join(state(spark, d).where("split is not null"), "patch_id")
    rn = (F.row_number().over(Window.partitionBy("split", "patient_id").orderBy("label", "filename")) - 1).cast("long")
    t = j.withColumn("row_index", rn)
    return t.select(F.lit("run-1").alias("run_id"), "split", "label", "patient_id", "filename", "row_index", F.concat(F.lit("images["), F.col("row_index").cast("string"), F.lit("]")).alias("image_ref"))


@query("c06_three_way_holdout", f"SELECT patient_id, label, CASE WHEN rn <= a THEN 'calibration' WHEN rn <= 2 * a THEN 'holdout' ELSE 'fit' END AS part FROM (SELECT patient_id, label, greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE)) AS a, row_number() OVER (PARTITION BY label ORDER BY {sel.shuffled_sql('patient_id', 3)}, patient_id) AS rn FROM (SELECT patient_id, max(label) AS label FROM patches GROUP BY 1))", "patches")
def c06(spark, d):
    return sel.holdout(patches(spark, d).groupBy("patient_id").agg(F.max("label").alias("label")), "patient_id", "label", 3)


@query("c07_stratified_sample", f"SELECT patch_id, patient_id, label FROM (SELECT *, count(*) OVER (PARTITION BY patient_id, label) AS n, row_number() OVER (PARTITION BY patient_id, label ORDER BY {sel.shuffled_sql('patch_id', 5)}, patch_id) AS rn FROM patches) WHERE rn <= ceil(0.3::DOUBLE * n)", "patches")
def c07(spark, d):
    return sel.stratified_sample(patches(spark, d), ["patient_id", "label"], "patch_id", 0.3, 5).select("patch_id", "patient_id", "label")


@query("c08_weighted_draws", "SELECT patch_id, draws FROM (SELECT patch_id, (ceil(round(c / t * 500 - 0.514, 9)) - ceil(round((c - w) / t * 500 - 0.514, 9)))::BIGINT AS draws FROM (SELECT patch_id, w, sum(w) OVER (ORDER BY patch_id) AS c, sum(w) OVER () AS t FROM (SELECT patch_id, CASE WHEN label = 1 THEN 16.0 ELSE 1.0 END::DOUBLE AS w FROM patches))) WHERE draws > 0", "patches")
def c08(spark, d):
    p = patches(spark, d).select("patch_id", F.when(F.col("label") == 1, 16.0).otherwise(1.0).alias("w"))
    return sel.weighted_draws(p, "patch_id", "w", 500, 6)


@query("c09_simple_sample", f"SELECT patch_id FROM patches ORDER BY {sel.shuffled_sql('patch_id', 9)}, patch_id LIMIT 100", "patches")
def c09(spark, d):
    return sel.simple_sample(patches(spark, d).select("patch_id"), "patch_id", 100, 9)


@query("c10_pool_and_pilot", f"SELECT patient_id, CASE WHEN row_number() OVER (ORDER BY {sel.shuffled_sql('patient_id', 2)}, patient_id) <= 20 THEN 'pilot' ELSE 'master' END AS part FROM (SELECT DISTINCT patient_id FROM patches ORDER BY {sel.shuffled_sql('patient_id', 2)}, patient_id LIMIT 80)", "patches")
def c10(spark, d):
    return sel.pool_and_pilot(patches(spark, d), "patient_id", 80, 20, 2)


@query("c11_latin_hypercube", f"SELECT point, dim, (row_number() OVER (PARTITION BY dim ORDER BY {sel.shuffled_sql('point + 131 * (dim + 1)', 4)}, point) - 0.5::DOUBLE) / 16 AS value FROM (SELECT unnest(range(16)) AS point) CROSS JOIN (SELECT unnest(range(3)) AS dim)")
def c11(spark, d):
    return sel.latin_hypercube(spark, 16, 3, 4)


@query("c24_group_folds")
def c24(spark, d):
    return sel.group_folds(_entities(spark, d), "patient_id", 5)


@query("c27_quota_sample", "SELECT vec_id, label FROM (SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY vec_id) > ceil(45::DOUBLE / (SELECT count(DISTINCT label) FROM embeddings)) THEN 1 ELSE 0 END AS over FROM embeddings) ORDER BY over, vec_id LIMIT 45")
def c27(spark, d):
    return sel.quota_sample(read(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 45)


@query("c28_adaptive_sample")
def c28(spark, d):
    return sel.select_adaptive(read(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.004, 3)


@query("c29_facility_location")
def c29(spark, d):
    return sel.select_diverse(read(spark, d, "embeddings"), "label", "vec_id", "embedding", 8)


@query("c30_landmark_quotas", "SELECT label, (f + CASE WHEN row_number() OVER (ORDER BY r DESC, label) <= 37 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM (SELECT label, floor(x) AS f, round(x - floor(x), 9) AS r FROM (SELECT label, count(*) * 37 / sum(count(*)) OVER ()::DOUBLE AS x FROM embeddings GROUP BY 1))")
def c30(spark, d):
    return sel.largest_remainder(read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")), "label", "n", 37)


@query("c31_protected_and_sampled", f"SELECT patch_id, 'protected' AS source FROM patches WHERE label = 1 UNION ALL SELECT patch_id, 'sampled' FROM (SELECT *, count(*) OVER (PARTITION BY patient_id) AS n, row_number() OVER (PARTITION BY patient_id ORDER BY {sel.shuffled_sql('patch_id', 8)}, patch_id) AS rn FROM patches WHERE label = 0) WHERE rn <= ceil(0.2::DOUBLE * n)", "patches")
def c31(spark, d):
    p = patches(spark, d)
    kept = sel.stratified_sample(p.where("label = 0"), ["patient_id"], "patch_id", 0.2, 8).select("patch_id", F.lit("sampled").alias("source"))
    return p.where("label = 1").select("patch_id", F.lit("protected").alias("source")).unionByName(kept)


@query("c32_patient_index", "SELECT patient_id, count(DISTINCT shard) AS n_shards, string_agg(CAST(row_index AS VARCHAR), ',' ORDER BY row_index) AS rows FROM indexed GROUP BY 1", "patches indexed")
def c32(spark, d):
    g = indexed(spark, d).groupBy("patient_id").agg(F.count_distinct("shard").alias("n_shards"), F.array_sort(F.collect_list("row_index")).alias("r"))
    return g.select("patient_id", "n_shards", F.array_join(F.col("r").cast("array<string>"), ",").alias("rows"))


@query("c33_unique_model", "SELECT r.brand, count(p.p_partkey) AS n, CASE count(p.p_partkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'duplicate' END AS status FROM (SELECT unnest(['Brand#1', 'Brand#7', 'Brand#99']) AS brand) r LEFT JOIN part p ON p.p_brand = r.brand AND p.p_size = 7 GROUP BY 1")
def c33(spark, d):
    asked = spark.createDataFrame([("Brand#1",), ("Brand#7",), ("Brand#99",)], "brand string")
    p = read(spark, d, "part").where("p_size = 7").select(F.col("p_brand").alias("brand"), "p_partkey")
    g = asked.join(p, "brand", "left").groupBy("brand").agg(F.count("p_partkey").alias("n"))
    return g.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "ok").otherwise("duplicate"))


@query("c36_provenance_match", "SELECT patch_id, want, have, want IS NULL OR want IS NOT DISTINCT FROM have AS matches FROM (SELECT patch_id, CASE WHEN patch_id % 3 = 0 THEN split END AS want, CASE WHEN patch_id % 7 = 0 THEN NULL ELSE split END AS have FROM state)", "state")
def c36(spark, d):
    s = state(spark, d).select("patch_id", F.when(F.col("patch_id") % 3 == 0, F.col("split")).alias("want"), F.when(F.col("patch_id") % 7 != 0, F.col("split")).alias("have"))
    return s.withColumn("matches", F.col("want").isNull() | F.col("want").eqNullSafe(F.col("have")))


@query("c40_bundle_resolution", "SELECT o_custkey % 10 AS grp, count(DISTINCT o_orderstatus) AS n, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS bundle FROM orders GROUP BY 1")
def c40(spark, d):
    g = read(spark, d, "orders").groupBy((F.col("o_custkey") % 10).alias("grp")).agg(F.collect_set("o_orderstatus").alias("s"))
    return g.select("grp", F.size("s").cast("long").alias("n"), F.when(F.size("s") == 1, F.col("s")[0]).alias("bundle"))


@query("c41_accepted_studies", "SELECT d.doc_id, d.source, d.n_chars FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1")
def c41(spark, d):
    ok = read(spark, d, "labels").where("quality = 1").select("doc_id")
    return read(spark, d, "documents").select("doc_id", "source", "n_chars").join(ok, "doc_id", "left_semi")


# Checks


@query("c34_quality_suite", """SELECT 'dataset' AS scope, 'duplicate_rows' AS "check", CASE WHEN (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
  UNION ALL SELECT 'dataset', 'patient_leakage', CASE WHEN (SELECT count(*) FROM (SELECT patient_id FROM patches JOIN state USING (patch_id) GROUP BY 1 HAVING count(DISTINCT split) > 1)) > 0 THEN 'FAIL' ELSE 'PASS' END
  UNION ALL SELECT 'dataset', 'filename_uniqueness', CASE WHEN (SELECT count(*) FROM (SELECT filename FROM patches GROUP BY 1 HAVING count(*) > 1)) > 0 THEN 'FAIL' ELSE 'PASS' END
  UNION ALL SELECT 'dataset', 'filename_patient', 'PASS' UNION ALL SELECT 'dataset', 'valid_labels', 'PASS' UNION ALL SELECT 'dataset', 'missing_splits', CASE WHEN (SELECT count(*) FROM state WHERE split IS NULL) > 0 THEN 'WARN' ELSE 'PASS' END
  UNION ALL SELECT 'dataset', 'overall', 'FAIL'""", "patches state")
def c34(spark, d):
    return quality.suite(patches(spark, d).join(state(spark, d), "patch_id"), read(spark, d, "lineitem"))


@query("c35_integrity", "SELECT 'lineitem.l_orderkey' AS key, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)")
def c35(spark, d):
    o = read(spark, d, "orders")
    a = quality.orphans(read(spark, d, "lineitem"), "l_orderkey", o, "o_orderkey", "lineitem.l_orderkey")
    return a.unionByName(quality.orphans(o, "o_custkey", read(spark, d, "customer").where("c_custkey % 50 <> 0"), "c_custkey", "orders.o_custkey"))


# References and names


@query("f01_patient_of_filename", "SELECT patch_id, CAST(regexp_extract(filename, 'PATIENT_(\\d+)_', 1) AS BIGINT) AS parsed, CAST(regexp_extract(filename, 'PATIENT_(\\d+)_', 1) AS BIGINT) = patient_id AS matches FROM patches", "patches")
def f01(spark, d):
    p = patches(spark, d)
    return p.select("patch_id", ref.patient_of(F.col("filename")).alias("parsed")).join(p.select("patch_id", "patient_id"), "patch_id").select("patch_id", "parsed", (F.col("parsed") == F.col("patient_id")).alias("matches"))


@query("f02_group_of_stem", "SELECT s_name, coalesce(nullif(trim(nullif(regexp_extract(stem, 'PATIENT_([^_]+)', 1), ''), '-_'), ''), stem) AS grp FROM (SELECT s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'PATIENT_-' || s_suppkey || '-_X' ELSE 'S' || s_suppkey END AS stem FROM supplier)")
def f02(spark, d):
    stem = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("PATIENT_-"), F.col("s_suppkey").cast("string"), F.lit("-_X"))).otherwise(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    return read(spark, d, "supplier").select("s_name", ref.group_of(stem).alias("grp"))


REFS = "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'HDF5::images[' || s_suppkey || ']' WHEN 1 THEN '/x/a.h5::images[' || s_suppkey || ']' WHEN 2 THEN 'plain.png' ELSE '' END AS image, CASE s_suppkey % 4 WHEN 0 THEN 'HDF5::masks[' || s_suppkey || ']' WHEN 1 THEN '/x/b.h5::masks[' || s_suppkey || ']' WHEN 2 THEN 'plain.png' ELSE '' END AS mask FROM supplier"


def _refs(spark, d):
    s = read(spark, d, "supplier")
    k, i = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    one = lambda kind, f: F.when(k == 0, F.concat(F.lit(f"HDF5::{kind}["), i, F.lit("]"))).when(k == 1, F.concat(F.lit(f"/x/{f}.h5::{kind}["), i, F.lit("]"))).when(k == 2, "plain.png").otherwise("")
    return s.select("s_suppkey", one("images", "a").alias("image"), one("masks", "b").alias("mask"))


@query("f03_reference_grammar", f"SELECT s_suppkey, nullif(regexp_extract(image, '::([^\\[\\]]+)\\[(\\d+)\\]$', 1), '') AS dataset, CAST(nullif(regexp_extract(image, '::([^\\[\\]]+)\\[(\\d+)\\]$', 2), '') AS BIGINT) AS row, CASE WHEN starts_with(image, 'HDF5::') THEN NULL ELSE nullif(regexp_extract(image, '^(.+)::', 1), '') END AS path FROM ({REFS})")
def f03(spark, d):
    r = _refs(spark, d)
    i = F.col("image")
    return r.select("s_suppkey", ref.dataset_of(i).alias("dataset"), ref.row_of(i).alias("row"), ref.path_of(i).alias("path"))


@query("f04_paired_references", f"SELECT s_suppkey, s_suppkey % 4 IN (0, 3) AS valid FROM ({REFS})")
def f04(spark, d):
    return _refs(spark, d).select("s_suppkey", ref.pair_is_valid(F.col("image"), F.col("mask")).alias("valid"))


@query("f05_sanitised", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(trim(p_brand || ' / ' || p_name), '[^A-Za-z0-9._-]+', '-', 'g'), '-._'), ''), 'unknown') AS safe FROM part")
def f05(spark, d):
    return read(spark, d, "part").select("p_partkey", ref.sanitised(F.concat("p_brand", F.lit(" / "), "p_name")).alias("safe"))


@query("f06_filename_builder", "SELECT p_partkey, 'pos_PATIENT_' || p_partkey || '_SLIDE_' || replace(p_brand, '#', '-') || '_X_' || p_size || '_Y_' || p_size * 2 || '.png' AS name FROM part")
def f06(spark, d):
    return read(spark, d, "part").select("p_partkey", ref.patch_filename(F.lit("pos"), F.col("p_partkey"), F.col("p_brand"), F.col("p_size"), F.col("p_size") * 2).alias("name"))


@query("f07_rooted_paths", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'SOURCE::a/' || s_name END AS reference, s_suppkey % 2 = 0 AS portable FROM supplier")
def f07(spark, d):
    path = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "/root_a/a/").otherwise("/other/"), F.col("s_name"))
    s = read(spark, d, "supplier").select("s_suppkey", ref.rooted(path, "/root_a", "SOURCE::").alias("reference"))
    return s.withColumn("portable", ref.is_portable(F.coalesce("reference", F.lit("/abs"))))


@query("f08_portable_candidates", "SELECT s_suppkey, 'MANIFEST::x/PATCHES/' || s_name || '|x/PATCHES/' || s_name || '|PATCHES/' || s_name || '|' || s_name AS keys FROM supplier")
def f08(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", F.array_join(ref.portable_candidates(F.concat(F.lit("MANIFEST::x/PATCHES/"), "s_name")), "|").alias("keys"))


@query("j08_two_phase_lookup")
def j08(spark, d):
    from lodestar.operators.quality import two_phase_lookup

    s = read(spark, d, "supplier")
    index = s.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("MANIFEST::v1/PATCHES/"), "s_name").alias("path"), F.col("s_suppkey").alias("target"))
    records = s.select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "MANIFEST::v1/PATCHES/").otherwise("/mnt/old/PATCHES/"), "s_name").alias("path"))
    return two_phase_lookup(records, index, "path", "target")


# Text


CLASSES = [("error", ("fail", "err")), ("money", ("pay", "buy", "purch")), ("view", ("view", "click"))]


@query("f09_record_fields")
def f09(spark, d):
    t = F.col("text")
    docs = read(spark, d, "documents").select("doc_id", F.concat(t, F.lit("\n## Code availability\nsee https://github. com/a/b.\n## References\ndoi: 10.1234/zzz")).alias("text"))
    stem = F.concat(F.lit("10."), F.col("doc_id").cast("string"), F.lit("_s41467-024-54769-y"))
    return docs.select("doc_id", txt.doi_of(F.col("text"), stem).alias("doi"), txt.year_of(F.col("text"), txt.doi_of(F.col("text"), stem)).alias("year"), txt.code_url(F.col("text")).alias("url"))


@query("f10_keyword_class", "SELECT event_id, CASE WHEN contains(lower(event_type), 'fail') OR contains(lower(event_type), 'err') THEN 'error' WHEN contains(lower(event_type), 'pay') OR contains(lower(event_type), 'buy') OR contains(lower(event_type), 'purch') THEN 'money' WHEN contains(lower(event_type), 'view') OR contains(lower(event_type), 'click') THEN 'view' ELSE 'other' END AS kind FROM events")
def f10(spark, d):
    return read(spark, d, "events").select("event_id", txt.first_class(F.col("event_type"), CLASSES, "other").alias("kind"))


@query("f11_before_references", "SELECT p_partkey, p_name || chr(10) AS body FROM part")
def f11(spark, d):
    t = F.concat("p_name", F.lit("\n## References\n[1] x\n## More\ny"))
    return read(spark, d, "part").select("p_partkey", txt.before_references(t).alias("body"))


@query("f12_bib_and_latex", "SELECT p_partkey, 'sysrev_' || lower(trim(regexp_replace(p_brand || '/' || p_name, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS bib, replace(replace(p_brand || '_50%', '#', '\\#'), '_50%', '\\_50\\%') AS latex FROM part")
def f12(spark, d):
    return read(spark, d, "part").select("p_partkey", txt.bib_key(F.concat("p_brand", F.lit("/"), "p_name"), F.lit("x")).alias("bib"), txt.latex_escaped(F.concat("p_brand", F.lit("_50%"))).alias("latex"))


@query("f13_hex_colour", "SELECT n_name, '#' || upper(printf('%06x', n_nationkey * 4097)) AS colour FROM nation")
def f13(spark, d):
    h = F.lpad(F.lower(F.hex(F.col("n_nationkey") * 4097)), 6, "0")
    return read(spark, d, "nation").select("n_name", ref.hex_colour(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" #"), h)).otherwise(h)).alias("colour"))


@query("f15_digests", "SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS digest, substr(sha256(c_name), 1, 12) AS short FROM customer")
def f15(spark, d):
    return read(spark, d, "customer").select("c_custkey", hashing.joined_digest([F.col("c_name"), F.col("c_mktsegment")]).alias("digest"), hashing.short_digest(F.col("c_name")).alias("short"))


@query("f14_json_digest", """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}') AS digest FROM nation""")
def f14(spark, d):
    return read(spark, d, "nation").select("n_nationkey", hashing.json_digest({"name": F.col("n_name"), "key": F.col("n_nationkey")}).alias("digest"))


@query("f16_row_set_signature", "SELECT o_custkey, sha256(string_agg(s, '' ORDER BY b)) AS signature FROM (SELECT o_custkey, floor(o_orderkey / 4096) AS b, sha256(string_agg(sha256(o_orderkey || '|' || o_orderstatus), '' ORDER BY o_orderkey)) AS s FROM orders GROUP BY 1, 2) GROUP BY 1")
def f16(spark, d):
    return hashing.row_set_digest(read(spark, d, "orders"), ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderstatus"])


# Arithmetic


@query("f19_chi_square", "SELECT split, round((p - n * g) ** 2 / (n * g) + ((n - p) - n * (1 - g)) ** 2 / (n * (1 - g)), 6) AS chi2 FROM (SELECT split, count(*) AS n, sum(label) AS p, (SELECT sum(label)::DOUBLE / count(*) FROM patches) AS g FROM patches JOIN state USING (patch_id) WHERE split IS NOT NULL GROUP BY 1)", "patches state")
def f19(spark, d):
    p = patches(spark, d)
    g = p.agg((F.sum("label") / F.count("*")).alias("g"))
    t = p.join(state(spark, d).where("split is not null"), "patch_id").groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("p")).join(F.broadcast(g))
    e, f = F.col("n") * F.col("g"), F.col("n") * (1 - F.col("g"))
    return t.select("split", F.round((F.col("p") - e) ** 2 / e + (F.col("n") - F.col("p") - f) ** 2 / f, 6).alias("chi2"))


@query("f20_sample_size", "SELECT level, ceil(z * z * 0.25 / (0.05 * 0.05))::BIGINT AS n FROM (SELECT unnest([0.9, 0.95, 0.99]::DOUBLE[]) AS level, unnest([1.645, 1.96, 2.576]::DOUBLE[]) AS z)")
def f20(spark, d):
    z = F.col("z")
    return spark.createDataFrame([(0.9, 1.645), (0.95, 1.96), (0.99, 2.576)], "level double, z double").select("level", F.ceil(z * z * 0.25 / (0.05 * 0.05)).alias("n"))


@query("f21_allocation_counts", "SELECT patient_id, least(n, greatest(2, floor(n * 0.2::DOUBLE)))::BIGINT AS k, round_even(n * 0.25::DOUBLE, 0)::BIGINT AS quarter FROM (SELECT patient_id, count(*) AS n FROM patches GROUP BY 1)", "patches")
def f21(spark, d):
    n = F.col("n")
    return patches(spark, d).groupBy("patient_id").agg(F.count("*").alias("n")).select("patient_id", F.least(n, F.greatest(F.lit(2), F.floor(n * 0.2))).cast("long").alias("k"), F.bround(n * 0.25).cast("long").alias("quarter"))


@query("f22_entropy", "SELECT l_suppkey, round(coalesce(-sum(p * log2(p)), 0.0), 6) AS entropy FROM (SELECT l_suppkey, n / sum(n) OVER (PARTITION BY l_suppkey)::DOUBLE AS p FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)) GROUP BY 1")
def f22(spark, d):
    return arr.entropy(read(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n")), "l_suppkey")


@query("f23_exponential_rate", "SELECT event_id, round(1e-6 * pow(1e6::DOUBLE, event_id / (SELECT max(event_id) FROM events)::DOUBLE), 9) AS rate FROM events")
def f23(spark, d):
    e = read(spark, d, "events").select("event_id")
    last = F.broadcast(e.agg(F.max("event_id").cast("double").alias("last")))  # one row
    return e.join(last).select("event_id", F.round(F.lit(1e-6) * F.pow(F.lit(1e6), F.col("event_id") / F.col("last")), 9).alias("rate"))


@query("f24_normalised_weights", "SELECT event_type, round(CASE WHEN w <= 1e-4 THEN 0 ELSE w END, 6) AS weight FROM (SELECT event_type, n / (sum(n) OVER () + 1e-9) AS w FROM (SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1))")
def f24(spark, d):
    n = read(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"))
    w = F.col("n") / (F.col("t") + 1e-9)
    return n.join(F.broadcast(n.agg(F.sum("n").alias("t")))).select("event_type", F.round(F.when(w <= 1e-4, 0.0).otherwise(w), 6).alias("weight"))


@query("f25_weighted_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 65535) AS INTEGER) / 65535.0::DOUBLE * (0.75 / (1.0 + 1e-9)))) + list_sum(list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * x::DOUBLE * 65535) AS INTEGER) / 65535.0::DOUBLE * (0.25 / (1.0 + 1e-9)))), 6) AS total FROM embeddings")
def f25(spark, d):
    a = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 65535).cast("int"))
    b = F.transform("embedding", lambda x: F.floor(x.cast("double") * x.cast("double") * 65535).cast("int"))
    e = read(spark, d, "embeddings").select("vec_id", a.alias("a"), b.alias("b"))
    return e.select("vec_id", F.round(arr.total(arr.weighted_sum([F.col("a"), F.col("b")], [0.75, 0.25])), 6).alias("total"))


@query("f26_distance_to_set", "SELECT e.vec_id, round(min(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))), 5) AS distance FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id < 5) s GROUP BY 1")
def f26(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    chosen = [r["v"] for r in e.where("vec_id < 5").select("v").collect()]  # a fixed handful
    gaps = [arr.distance(F.col("v"), F.array(*(F.lit(x) for x in c))) for c in chosen]
    return e.select("vec_id", F.round(F.least(*gaps), 5).alias("distance"))


def _masks(spark, d):
    one = lambda t: F.transform("embedding", lambda x: (x > F.lit(t).cast("float")).cast("int"))
    return read(spark, d, "embeddings").select("vec_id", one(0.1).alias("pred"), one(0.05).alias("truth"))


MASKS = "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.1::FLOAT THEN 1 ELSE 0 END) AS pred, list_transform(embedding, lambda x: CASE WHEN x > 0.05::FLOAT THEN 1 ELSE 0 END) AS truth FROM embeddings"


@query("f27_mask_labels", f"SELECT vec_id, list_sum(pred)::DOUBLE / len(pred) >= 0.2 AS label, list_sum(pred) > 0 AS any_set FROM ({MASKS})")
def f27(spark, d):
    return _masks(spark, d).select("vec_id", arr.mask_label(F.col("pred"), 0.2).alias("label"), arr.mask_label(F.col("pred"), 0).alias("any_set"))


@query("f28_mask_confusion", f"SELECT vec_id, list_sum(list_transform(list_zip(pred, truth), lambda z: z[1] * z[2]))::BIGINT AS tp, list_sum(list_transform(list_zip(pred, truth), lambda z: z[1] * (1 - z[2])))::BIGINT AS fp, list_sum(list_transform(list_zip(pred, truth), lambda z: (1 - z[1]) * z[2]))::BIGINT AS fn, list_sum(list_transform(list_zip(pred, truth), lambda z: (1 - z[1]) * (1 - z[2])))::BIGINT AS tn FROM ({MASKS})")
def f28(spark, d):
    return _masks(spark, d).select("vec_id", *(v.alias(k) for k, v in arr.mask_confusion(F.col("pred"), F.col("truth")).items()))


@query("f29_component_filter")
def f29(spark, d):
    return read(spark, d, "embeddings").select("vec_id", arr.kept_pixels_udf(0.0, 4)(F.col("embedding")).alias("kept"))


@query("f30_mask_values", f"SELECT vec_id, len(list_distinct(pred)) AS n_values, list_contains(pred, 1) AS any_positive, len(pred) AS size FROM ({MASKS})")
def f30(spark, d):
    return _masks(spark, d).select("vec_id", F.size(F.array_distinct("pred")).cast("long").alias("n_values"), F.exists("pred", lambda x: x == 1).alias("any_positive"), F.size("pred").cast("long").alias("size"))


@query("f31_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS channel FROM embeddings")
def f31(spark, d):
    return read(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("long").alias("channel"))


@query("f33_gated_product", f"SELECT vec_id, list_sum(list_transform(list_zip(pred, truth), lambda z: z[1] * z[2]))::BIGINT AS gated FROM ({MASKS})")
def f33(spark, d):
    return _masks(spark, d).select("vec_id", arr.total(F.zip_with("pred", "truth", lambda a, b: a * b)).cast("long").alias("gated"))


@query("f34_nested_default", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, coalesce(json_extract_string(props, '$.classification.name'), 'none') AS name FROM events")
def f34(spark, d):
    p = F.col("props")
    name = F.coalesce(F.get_json_object(p, "$.classification.name"), F.get_json_object(p, "$.classification"), F.lit("none"))
    return read(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(p, "$.k").cast("int"), F.lit(-1)).alias("k"), name.alias("name"))


@query("f35_payload_validation", "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_key, json_extract_string(props, '$.version') IS NOT NULL AS has_version FROM events")
def f35(spark, d):
    return read(spark, d, "events").select("event_id", *(F.get_json_object("props", f"$.{k}").isNotNull().alias(n) for k, n in (("k", "has_key"), ("version", "has_version"))))


@query("c37_window_tiles", "SELECT n_nationkey, x::INTEGER AS x, y::INTEGER AS y FROM (SELECT n_nationkey, unnest(range(0, 60 + n_nationkey * 10 - 32 + 1, 16)) AS x, n_regionkey FROM nation) CROSS JOIN (SELECT unnest(range(0, 80 - 32 + 1, 16)) AS y)")
def c37(spark, d):
    a = read(spark, d, "nation").select("n_nationkey", (60 + F.col("n_nationkey") * 10).alias("w"), F.lit(80).alias("h"))
    return geometry.tiles(a, "n_nationkey", "w", "h", 32, 16)


BOXES = "SELECT p_partkey AS box, (p_partkey * 37 % 900)::DOUBLE AS x0, (p_partkey * 53 % 900)::DOUBLE AS y0, (p_partkey * 37 % 900 + p_size)::DOUBLE AS x1, (p_partkey * 53 % 900 + p_size)::DOUBLE AS y1 FROM part"
WINDOWS = "SELECT s_suppkey AS \"window\", (s_suppkey * 91 % 900)::DOUBLE AS x, (s_suppkey * 29 % 900)::DOUBLE AS y FROM supplier"


@query("j12_windows_on_boxes", f'SELECT "window", box, (least(x + 64, x1) - greatest(x, x0)) * (least(y + 64, y1) - greatest(y, y0)) AS area FROM ({WINDOWS}) w JOIN ({BOXES}) b ON x < x1 AND x0 < x + 64 AND y < y1 AND y0 < y + 64')
def j12(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    b = read(spark, d, "part").select(k.alias("box"), (k * 37 % 900).cast("double").alias("x0"), (k * 53 % 900).cast("double").alias("y0"), (k * 37 % 900 + s).cast("double").alias("x1"), (k * 53 % 900 + s).cast("double").alias("y1"))
    i = F.col("s_suppkey")
    w = read(spark, d, "supplier").select(i.alias("window"), (i * 91 % 900).cast("double").alias("x"), (i * 29 % 900).cast("double").alias("y"))
    return geometry.windows_on_boxes(w, b, 64, 128)


@query("c38_ambiguous_regions", f"SELECT box FROM ({BOXES}) a WHERE box % 2 = 0 AND NOT EXISTS (SELECT 1 FROM ({BOXES}) b WHERE b.box % 2 = 1 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)")
def c38(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    box = read(spark, d, "part").select(k.alias("box"), (k * 37 % 900).cast("double").alias("x0"), (k * 53 % 900).cast("double").alias("y0"), (k * 37 % 900 + s).cast("double").alias("x1"), (k * 53 % 900 + s).cast("double").alias("y1"))
    return quality.unambiguous(box.where("box % 2 = 0"), box.where("box % 2 = 1"), 64)

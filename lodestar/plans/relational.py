"""Queries: scans, filters, state changes, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import relational as rel
from lodestar.operators import state as st
from lodestar.plans.base import indexed, patches, query, rates, read, scored, state

# Scans and sinks


@query("s01_manifest_scan", "SELECT patch_id, patient_id, shard, row_index, label FROM indexed ORDER BY shard, row_index", "patches indexed")
def s01(spark, d):
    return indexed(spark, d).select("patch_id", "patient_id", "shard", "row_index", "label").orderBy("shard", "row_index")


@query("s02_accepted_rows", "SELECT p.patch_id, p.patient_id, p.filename, p.label, s.split FROM patches p JOIN state s USING (patch_id) WHERE s.is_accepted = 1", "patches state")
def s02(spark, d):
    return patches(spark, d).join(state(spark, d).where("is_accepted = 1"), "patch_id").select("patch_id", "patient_id", "filename", "label", "split")


@query("s14_accepted_manifest_first", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem WHERE l_linestatus = 'F') WHERE rn = 1")
def s14(spark, d):
    li = read(spark, d, "lineitem").where("l_linestatus = 'F'")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return li.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("s20_contiguous_spans", "SELECT shard, min(row_index) AS first, max(row_index) + 1 AS past, count(*) AS length FROM (SELECT shard, row_index, row_index - row_number() OVER (PARTITION BY shard ORDER BY row_index) AS k FROM indexed JOIN state USING (patch_id) WHERE is_accepted = 1) GROUP BY shard, k", "patches indexed state")
def s20(spark, d):
    return rel.islands(indexed(spark, d).join(state(spark, d).where("is_accepted = 1"), "patch_id"), "shard", "row_index")


@query("k02_shard_merge", "SELECT patient_id, filename, source, row_number() OVER (PARTITION BY patient_id ORDER BY filename, source, row_index) - 1 AS position FROM (SELECT *, CASE WHEN patch_id % 2 = 0 THEN 0 ELSE 1 END AS source FROM indexed)", "patches indexed")
def k02(spark, d):
    p = indexed(spark, d)
    both = p.where("patch_id % 2 = 0").withColumn("source", F.lit(0)).unionByName(p.where("patch_id % 2 <> 0").withColumn("source", F.lit(1)))
    w = Window.partitionBy("patient_id").orderBy("filename", "source", "row_index")
    return both.select("patient_id", "filename", "source", (F.row_number().over(w) - 1).cast("long").alias("position"))


@query("k03_filter_by_manifest", "SELECT i.shard, i.row_index, i.patch_id, row_number() OVER (PARTITION BY i.shard ORDER BY s.patch_id DESC) - 1 AS position FROM indexed i JOIN state s USING (patch_id) WHERE s.is_accepted = 1 AND s.is_selected = 1", "patches indexed state")
def k03(spark, d):
    accepted = state(spark, d).where("is_accepted = 1 and is_selected = 1").select("patch_id")
    w = Window.partitionBy("shard").orderBy(F.desc("patch_id"))
    return indexed(spark, d).join(accepted, "patch_id").select("shard", "row_index", "patch_id", (F.row_number().over(w) - 1).cast("long").alias("position"))


# Projections, filters, mutation


@query("p01_split_filter", "SELECT p.patient_id, p.shard, p.row_index, p.patch_id FROM indexed p JOIN state s USING (patch_id) WHERE s.is_accepted = 1 AND s.split = 'TRAIN' AND s.is_selected = 1 ORDER BY 1, 2, 3", "patches indexed state")
def p01(spark, d):
    s = state(spark, d).where("is_accepted = 1 and split = 'TRAIN' and is_selected = 1").select("patch_id")
    return indexed(spark, d).join(s, "patch_id").select("patient_id", "shard", "row_index", "patch_id").orderBy("patient_id", "shard", "row_index")


@query("p02_optional_column", "SELECT patch_id, CAST(NULL AS VARCHAR) AS annotation_path, filename FROM patches", "patches")
def p02(spark, d):
    t = patches(spark, d)
    column = F.col("annotation_path") if "annotation_path" in t.columns else F.lit(None).cast("string").alias("annotation_path")
    return t.select("patch_id", column, "filename")


@query("p03_requested_ids", "SELECT pos, o.o_orderkey, o.o_orderstatus FROM (SELECT unnest([7, 3, 999999999, 11]) AS o_orderkey, unnest([0, 1, 2, 3]) AS pos) r JOIN orders o ON o.o_orderkey = r.o_orderkey")
def p03(spark, d):
    asked = spark.createDataFrame([(i, k) for i, k in enumerate([7, 3, 999999999, 11])], "pos int, o_orderkey long")
    return read(spark, d, "orders").join(F.broadcast(asked), "o_orderkey").select("pos", "o_orderkey", "o_orderstatus").orderBy("pos")


@query("p04_pending_queue", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def p04(spark, d):
    return read(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus")


@query("p05_candidates_and_bypass", "SELECT patch_id, 'candidate' AS route, NULL::VARCHAR AS decision FROM patches WHERE label = 1 UNION ALL SELECT patch_id, 'bypass', 'accepted' FROM patches WHERE label = 0", "patches")
def p05(spark, d):
    p = patches(spark, d).select("patch_id", "label")
    yes = p.where("label = 1").select("patch_id", F.lit("candidate").alias("route"), F.lit(None).cast("string").alias("decision"))
    return yes.unionByName(p.where("label = 0").select("patch_id", F.lit("bypass").alias("route"), F.lit("accepted").alias("decision")))


@query("p06_cleaning_decision", "SELECT p.patch_id, r.rate, CASE WHEN p.label = 1 AND r.rate IS NOT NULL AND r.rate > 0.05 THEN 'rejected' ELSE 'accepted' END AS decision FROM patches p LEFT JOIN rates r USING (patch_id)", "patches rates")
def p06(spark, d):
    j = patches(spark, d).join(rates(spark, d), "patch_id", "left")
    bad = (F.col("label") == 1) & F.col("rate").isNotNull() & ~F.isnan("rate") & (F.col("rate") > 0.05)
    return j.select("patch_id", "rate", F.when(bad, "rejected").otherwise("accepted").alias("decision"))


@query("p07_window_label", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_discount >= 0.05 AND l_tax >= 0.04 THEN 'skipped' WHEN l_discount >= 0.05 THEN 'positive' WHEN l_tax >= 0.04 THEN 'negative' ELSE 'none' END AS decision FROM lineitem")
def p07(spark, d):
    a, b = F.col("l_discount") >= 0.05, F.col("l_tax") >= 0.04
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(a & b, "skipped").when(a, "positive").when(b, "negative").otherwise("none").alias("decision"))


@query("p08_ingest_decision", "SELECT o.o_orderkey, CASE WHEN c.c_custkey IS NULL THEN 'FAILED' WHEN o.o_orderstatus = 'F' THEN 'EXISTING' WHEN o.o_orderstatus = 'P' THEN 'STALE' ELSE 'TO BE PROCESSED' END AS status FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal >= 0")
def p08(spark, d):
    c = read(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("seen"))
    s = F.when(F.col("seen").isNull(), "FAILED").when(F.col("o_orderstatus") == "F", "EXISTING").when(F.col("o_orderstatus") == "P", "STALE").otherwise("TO BE PROCESSED")
    return read(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", s.alias("status"))


@query("p09_sampling_decision", "SELECT p.patch_id, CASE WHEN label = 1 THEN 'protected' WHEN is_selected = 1 THEN 'sampled' ELSE 'rejected' END AS decision FROM patches p JOIN state USING (patch_id)", "patches state")
def p09(spark, d):
    j = patches(spark, d).join(state(spark, d), "patch_id")
    return j.select("patch_id", F.when(F.col("label") == 1, "protected").when(F.col("is_selected") == 1, "sampled").otherwise("rejected").alias("decision"))


@query("p10_model_candidates", "SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#17') AND p_retailprice IS NOT NULL AND NOT isnan(p_retailprice)")
def p10(spark, d):
    return read(spark, d, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#17") & F.col("p_retailprice").isNotNull() & ~F.isnan("p_retailprice")).select("p_partkey", "p_brand", "p_retailprice")


@query("p11_allowed_patients", "SELECT patch_id, patient_id FROM patches WHERE patient_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "patches")
def p11(spark, d):
    allowed = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("patient_id"))
    return patches(spark, d).join(allowed, "patient_id", "left_semi").select("patch_id", "patient_id")


@query("p12_invalid_batches", "SELECT patch_id, split, is_selected FROM state WHERE split IS NOT NULL AND is_selected IS NOT NULL", "state")
def p12(spark, d):
    return state(spark, d).select("patch_id", "split", "is_selected").dropna()


@query("p13_group_columns", "SELECT patient_id, count(*) - sum(label)::BIGINT AS negative, round(sum(label)::DOUBLE / count(*), 6) AS ratio FROM patches GROUP BY 1", "patches")
def p13(spark, d):
    g = patches(spark, d).groupBy("patient_id").agg(F.count("*").alias("n"), F.sum("label").alias("s"))
    return g.withColumns({"negative": F.col("n") - F.col("s"), "ratio": F.round(F.col("s") / F.col("n"), 6)}).select("patient_id", "negative", "ratio")


@query("p14_expanded_references", "SELECT patch_id, '/data/' || substr(shard, 11) || '::images[' || row_index || ']' AS image_path, '/data/' || substr(shard, 11) || '::masks[' || row_index || ']' AS mask_path FROM indexed", "patches indexed")
def p14(spark, d):
    from lodestar.functions.references import expand

    t = indexed(spark, d)
    ref = lambda kind: F.concat(F.lit(f"HDF5::{kind}["), F.col("row_index").cast("string"), F.lit("]"))
    return t.select("patch_id", expand(ref("images"), F.col("shard"), "/data").alias("image_path"), expand(ref("masks"), F.col("shard"), "/data").alias("mask_path"))


@query("p15_registry_expansion", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey >= 2 AND r_regionkey <= n_regionkey")
def p15(spark, d):
    encoders = read(spark, d, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("all"))
    plans = read(spark, d, "nation").where("n_regionkey >= 2").join(F.broadcast(encoders))
    return plans.select("n_name", F.explode(F.filter("all", lambda x: x["r_regionkey"] <= F.col("n_regionkey"))).alias("e")).select("n_name", "e.r_name")


@query("u01_replace_shard", "SELECT patch_id, patient_id, label FROM patches WHERE patient_id % 10 <> 0 UNION ALL SELECT patch_id + 1000000, patient_id, 1 - label FROM patches WHERE patient_id % 10 = 0", "patches")
def u01(spark, d):
    old = patches(spark, d).select("patch_id", "patient_id", "label")
    new = old.where("patient_id % 10 = 0").select((F.col("patch_id") + 1000000).alias("patch_id"), "patient_id", (1 - F.col("label")).alias("label"))
    return st.replace_by_key(old, new, "patient_id")


@query("u02_keyed_update", "SELECT s.patch_id, coalesce(CASE WHEN r.rate > 0.05 THEN 0 END, s.is_accepted) AS is_accepted, s.split FROM state s LEFT JOIN rates r USING (patch_id)", "state rates")
def u02(spark, d):
    changes = rates(spark, d).select("patch_id", F.when(F.col("rate") > 0.05, 0).alias("is_accepted"))
    return st.update_by_key(state(spark, d).select("patch_id", "is_accepted", "split"), changes, "patch_id", ["is_accepted"])


@query("u04_sync_queue", """SELECT coalesce(q.name, m.name) AS name, coalesce(m.sig, q.sig) AS sig,
  CASE WHEN q.name IS NULL OR (m.sig IS NOT NULL AND m.sig <> q.sig) THEN 'PENDING' ELSE q.status END AS status
  FROM (SELECT s_name AS name, s_nationkey AS sig, 'DONE' AS status FROM supplier WHERE s_suppkey % 3 <> 0) q
  FULL JOIN (SELECT s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS sig FROM supplier WHERE s_suppkey % 7 <> 0) m ON q.name = m.name""")
def u04(spark, d):
    s = read(spark, d, "supplier")
    queue = s.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("sig"), F.lit("DONE").alias("status"))
    now = s.where("s_suppkey % 7 <> 0")
    early = now.select(F.col("s_name").alias("name"), F.lit(-1).alias("sig"), F.lit(0).alias("pos"))
    late = now.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_nationkey") + 100).otherwise(F.col("s_nationkey")).alias("sig"), F.lit(1).alias("pos"))
    return st.sync_queue(queue, early.unionByName(late), "name", "sig", "pos")


@query("u05_state_transitions", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'PROCESSING' ELSE o_orderstatus END AS status FROM orders")
def u05(spark, d):
    s = F.when(F.col("o_orderkey") % 10 == 1, "FAILED").when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise(F.col("o_orderstatus"))
    return read(spark, d, "orders").select("o_orderkey", s.alias("status"))


@query("u06_new_ids", "SELECT n_name, (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY n_name) AS run_id FROM nation")
def u06(spark, d):
    old = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("run_id"))
    return st.with_new_ids(old, read(spark, d, "nation").select("n_name"), "run_id", ["n_name"])


@query("u07_insert_or_ignore", "SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def u07(spark, d):
    old = read(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k")).distinct()
    return st.insert_if_absent(old, read(spark, d, "orders").select(F.col("o_orderkey").alias("k")), ["k"])


@query("u08_link_guard", "SELECT n_regionkey, upper(s_name[1:9]) || CAST(s_suppkey % 2 AS VARCHAR) AS method, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(*) > 1")
def u08(spark, d):
    links = read(spark, d, "supplier").select("s_nationkey", F.concat(F.substring("s_name", 1, 9), (F.col("s_suppkey") % 2).cast("string")).alias("method"))
    return st.links_break_rule(links, read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "n_regionkey", "s_nationkey", "method")


# Joins


@query("j01_patch_state", "SELECT p.patch_id, p.patient_id, s.split, s.is_accepted FROM patches p JOIN state s USING (patch_id)", "patches state")
def j01(spark, d):
    return patches(spark, d).join(state(spark, d), "patch_id").select("patch_id", "patient_id", "split", "is_accepted")


@query("j02_ordered_lookup", "SELECT pos, k.patient_id, k.row_index, i.patch_id, i.patch_id IS NULL AS missed FROM (SELECT c_custkey AS patient_id, c_custkey % 8 AS row_index, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS pos FROM customer) k LEFT JOIN indexed i USING (patient_id, row_index)", "patches indexed")
def j02(spark, d):
    keys = read(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), (F.col("c_custkey") % 8).alias("row_index"))
    keys = rel.positions(keys, [-F.floor(F.col("patient_id") / 4096)], [F.desc("patient_id")], "pos").withColumn("pos", F.col("pos") - 1)
    return rel.ordered_lookup(keys, indexed(spark, d).select("patient_id", "row_index", "patch_id"), ["patient_id", "row_index"], "pos").select("pos", "patient_id", "row_index", "patch_id", "missed")


@query("j03_method_join", "SELECT p.p_partkey, r.r_name FROM part p JOIN region r ON upper(substr(p.p_type, 1, 1)) = upper(substr(r.r_name, 1, 1))")
def j03(spark, d):
    r = read(spark, d, "region").select(F.upper(F.substring("r_name", 1, 1)).alias("k"), "r_name")
    return read(spark, d, "part").withColumn("k", F.upper(F.substring("p_type", 1, 1))).join(F.broadcast(r), "k").select("p_partkey", "r_name")


@query("j04_left_default", "SELECT p.patch_id, coalesce(r.rate, 0.0) AS rate FROM patches p LEFT JOIN rates r USING (patch_id)", "patches rates")
def j04(spark, d):
    return patches(spark, d).select("patch_id").join(rates(spark, d).select("patch_id", "rate"), "patch_id", "left").fillna({"rate": 0.0})


@query("j05_last_stem", "SELECT c.c_custkey, o.last_order FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def j05(spark, d):
    last = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    return read(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left")


@query("j06_ambiguous_stems", "SELECT p_name, count(*) FILTER (p_size < 25) AS legacy, count(*) FILTER (p_size >= 25) AS hashed, count(*) FILTER (p_size < 25) + count(*) FILTER (p_size >= 25) > 1 AS ambiguous FROM part GROUP BY 1")
def j06(spark, d):
    g = read(spark, d, "part").groupBy("p_name").agg(F.count_if(F.col("p_size") < 25).alias("legacy"), F.count_if(F.col("p_size") >= 25).alias("hashed"))
    return g.withColumn("ambiguous", F.col("legacy") + F.col("hashed") > 1)


@query("j07_labels_and_misses", "SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'missed' ELSE 'matched' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def j07(spark, d):
    lab = read(spark, d, "labels").select("doc_id", "quality", F.lit("matched").alias("status"))
    return read(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left").fillna({"status": "missed"})


@query("j09_coverage_default", "SELECT p.patch_id, coalesce(r.cover, 0.0) AS cover, coalesce(r.n_lines, 0) AS n_lines FROM patches p LEFT JOIN rates r USING (patch_id)", "patches rates")
def j09(spark, d):
    return patches(spark, d).select("patch_id").join(rates(spark, d).select("patch_id", "cover", "n_lines"), "patch_id", "left").fillna({"cover": 0.0, "n_lines": 0})


@query("j10_disk_parity", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'missing_left' WHEN b.k IS NULL THEN 'missing_right' ELSE 'differs' END AS status FROM (SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey % 9 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_custkey END AS v FROM orders WHERE o_orderkey % 7 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def j10(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    return rel.full_compare(o.where("k % 9 <> 0"), o.where("k % 7 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, -1).otherwise(F.col("v"))), ["k"], ["v"])


@query("j13_positional_join", "SELECT a.l_orderkey, round(a.s + b.s, 2) AS both FROM (SELECT l_orderkey, sum(l_quantity) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) a JOIN (SELECT l_orderkey, sum(l_quantity) AS s FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) b USING (l_orderkey)")
def j13(spark, d):
    li = read(spark, d, "lineitem")
    one = lambda c, n: li.where(c).groupBy("l_orderkey").agg(F.sum("l_quantity").alias(n))
    return one("l_linenumber <= 3", "a").join(one("l_linenumber > 3", "b"), "l_orderkey").select("l_orderkey", F.round(F.col("a") + F.col("b"), 2).alias("both"))


@query("j14_semi_and_anti", "SELECT o_orderkey, 'with' AS side FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT o_orderkey, 'without' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j14(spark, d):
    o = read(spark, d, "orders").select("o_orderkey")
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(li, "o_orderkey", "left_semi").withColumn("side", F.lit("with")).unionByName(o.join(li, "o_orderkey", "left_anti").withColumn("side", F.lit("without")))


# Aggregates


@query("a01_patient_table", "SELECT patient_id, count(*) AS total, sum(label)::BIGINT AS positive, count(*) - sum(label)::BIGINT AS negative, sum(label)::DOUBLE / count(*) AS ratio, CASE WHEN sum(label) > 0 THEN 1 ELSE 0 END AS label FROM patches GROUP BY 1", "patches")
def a01(spark, d):
    return rel.entity_table(patches(spark, d), "patient_id", "label")


@query("a02_global_ratio", "SELECT sum(label)::DOUBLE / count(*) AS ratio FROM patches", "patches")
def a02(spark, d):
    return rel.global_ratio(patches(spark, d), "label")


@query("a03_availability_by_split", "SELECT coalesce(split, '<NULL>') AS split, count(*) AS n_rows, count(*) FILTER (is_accepted = 1) AS n_accepted, count(*) FILTER (is_accepted = 1 AND is_selected = 1) AS n_selected FROM patches JOIN state USING (patch_id) GROUP BY 1", "patches state")
def a03(spark, d):
    return rel.availability(patches(spark, d).join(state(spark, d), "patch_id"), "split", "is_accepted", "is_selected")


SPLIT_STATS = """SELECT split, count(*) AS n_patients, count(*) FILTER (a = 1) AS n_pos_patients, count(*) FILTER (a = 0) AS n_neg_patients, sum(n)::BIGINT AS n_images,
  round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 0.0), 6) AS std, min(n) AS min, quantile_cont(n, 0.25)::DOUBLE AS q1, quantile_cont(n, 0.5)::DOUBLE AS median, quantile_cont(n, 0.75)::DOUBLE AS q3, max(n) AS max,
  sum(n - pos)::BIGINT AS n_images_neg, sum(pos)::BIGINT AS n_images_pos
  FROM (SELECT split, patient_id, count(*) AS n, max(label) AS a, count(*) FILTER (label = 1) AS pos FROM patches JOIN state USING (patch_id) WHERE is_accepted = 1 AND split IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""


@query("a04_split_statistics", SPLIT_STATS, "patches state")
def a04(spark, d):
    return rel.split_statistics(patches(spark, d).join(state(spark, d).where("is_accepted = 1 and split is not null"), "patch_id"), "split", "patient_id", "label")


@query("a05_rows_per_patient", "SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS min, quantile_cont(n, 0.5)::DOUBLE AS median, max(n) AS max, max(n) > 20 * greatest(1.0, quantile_cont(n, 0.5)) AS warn FROM (SELECT count(*) AS n FROM patches GROUP BY patient_id)", "patches")
def a05(spark, d):
    return rel.size_check(patches(spark, d), "patient_id")


@query("a06_group_median", "SELECT patient_id, median(score) AS median FROM patches GROUP BY 1", "patches")
def a06(spark, d):
    return patches(spark, d).groupBy("patient_id").agg(F.median("score").alias("median"))


@query("a07_argmax_row", "SELECT patient_id, patch_id, score FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY score DESC, patch_id) AS rn FROM patches) WHERE rn = 1", "patches")
def a07(spark, d):
    return rel.first_max_row(patches(spark, d), "patient_id", "score", "patch_id").select("patient_id", "patch_id", "score")


@query("a08_stack_median", "SELECT label, pos::INTEGER AS pos, CAST(trunc(median(v)) AS INTEGER) AS value FROM (SELECT label, unnest(embedding) * 1000 AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def a08(spark, d):
    from lodestar.functions.arrays import stack_median

    e = read(spark, d, "embeddings")
    return stack_median(e.withColumn("v", F.transform("embedding", lambda x: x * 1000)), "label", "v")


@query("a09_patient_balance", "SELECT sum(l)::BIGINT AS positive, count(*) - sum(l)::BIGINT AS negative FROM (SELECT max(label) AS l FROM patches GROUP BY patient_id)", "patches")
def a09(spark, d):
    g = patches(spark, d).groupBy("patient_id").agg(F.max("label").alias("l"))
    return g.agg(F.sum("l").cast("long").alias("positive"), (F.count("*") - F.sum("l")).cast("long").alias("negative"))


@query("a10_class_balance", "SELECT label, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM patches), 6) AS percent FROM patches GROUP BY 1", "patches")
def a10(spark, d):
    g = patches(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("t")))).select("label", "n", F.round(F.lit(100.0) * F.col("n") / F.col("t"), 6).alias("percent"))


@query("a11_leakage", "SELECT l_suppkey, count(DISTINCT split) AS n_splits FROM lineitem JOIN state ON patch_id = l_orderkey GROUP BY 1 HAVING count(DISTINCT split) > 1", "state")
def a11(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("patch_id"), "l_suppkey").join(state(spark, d), "patch_id")
    return rel.leaked_entities(rows, "l_suppkey", "split")


@query("a12_duplicate_rows", "SELECT sum(n - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def a12(spark, d):
    return rel.surplus_duplicates(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a13_repeated_names", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def a13(spark, d):
    return rel.repeated_values(read(spark, d, "part"), "p_name")


@query("a14_distinct_listed", "SELECT string_agg(v, ',' ORDER BY v) AS listed FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)")
def a14(spark, d):
    return rel.distinct_listed(read(spark, d, "customer"), "c_mktsegment")


@query("a15_filtered_count", "SELECT count(*) FILTER (is_accepted = 1) AS n FROM state", "state")
def a15(spark, d):
    return state(spark, d).agg(F.count_if(F.col("is_accepted") == 1).alias("n"))


@query("a16_screening_summary", "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality IS NULL OR quality <> 1) AS rejected FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def a16(spark, d):
    j = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rel.with_total(j, "source", {"n": F.count("*"), "accepted": F.count_if(F.col("quality") == 1), "rejected": F.count_if(F.col("quality").isNull() | (F.col("quality") != 1))})


@query("a17_decision_counts", "SELECT CASE WHEN label = 1 AND rate > 0.05 THEN 'rejected' ELSE 'accepted' END AS decision, count(*) AS n FROM patches LEFT JOIN rates USING (patch_id) GROUP BY 1", "patches rates")
def a17(spark, d):
    return p06(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


@query("a18_status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a18(spark, d):
    return read(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("a19_phase_profile", "SELECT event_type, round(sum(value), 6) AS seconds, count(*) AS calls, round(sum(value) / count(*), 6) AS mean_seconds, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY 1")
def a19(spark, d):
    return rel.phase_profile(read(spark, d, "events"), "event_type", "value")


@query("a20_class_weights", "SELECT patch_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY label) AS weight FROM patches", "patches")
def a20(spark, d):
    return rel.class_weights(patches(spark, d), "label").select("patch_id", "weight")


@query("a21_sampling_totals", "SELECT count(*) AS n, count(*) FILTER (label = 1) AS protected, count(*) FILTER (label = 0 AND is_selected = 1) AS sampled, round(coalesce(count(*) FILTER (label = 0 AND is_selected = 1)::DOUBLE / nullif(count(*) FILTER (label = 0), 0), 0.0), 6) AS kept_fraction, round(coalesce(count(*) FILTER (label = 7)::DOUBLE / nullif(count(*) FILTER (label = 8), 0), 0.0), 6) AS none_fraction FROM patches JOIN state USING (patch_id)", "patches state")
def a21(spark, d):
    j = patches(spark, d).join(state(spark, d), "patch_id")
    c = lambda x: F.count_if(F.expr(x)).cast("double")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0)), 6)
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("protected"), F.count_if(F.expr("label = 0 and is_selected = 1")).alias("sampled"), share("label = 0 and is_selected = 1", "label = 0").alias("kept_fraction"), share("label = 7", "label = 8").alias("none_fraction"))


@query("a22_weighted_mean", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def a22(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("mean"))


@query("a23_reason_list", "SELECT string_agg(event_type || '=' || n, ', ' ORDER BY n DESC, event_type) AS reasons FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def a23(spark, d):
    g = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "event_type")))
    return g.agg(F.array_join(F.transform(listed, lambda x: F.concat(x["event_type"], F.lit("="), (-x["k"]).cast("string"))), ", ").alias("reasons"))


@query("a24_distinct_shards", "SELECT count(DISTINCT shard) AS n FROM patches", "patches")
def a24(spark, d):
    return patches(spark, d).agg(F.count_distinct("shard").alias("n"))


@query("a25_positive_patients", "SELECT patient_id, bool_or(label <> 0) AS positive, min(patch_id) AS first_seen FROM patches GROUP BY 1", "patches")
def a25(spark, d):
    return patches(spark, d).groupBy("patient_id").agg(F.bool_or(F.col("label") != 0).alias("positive"), F.min("patch_id").alias("first_seen"))


@query("a26_histogram", "SELECT t.truth, b.bin::INTEGER AS bin, count(s.event_id) AS n FROM (SELECT unnest([0, 1]) AS truth) t CROSS JOIN (SELECT unnest(range(32)) AS bin) b LEFT JOIN (SELECT event_id, truth, least(CAST(floor(p * 32) AS INTEGER), 31) AS bin FROM scored) s ON s.truth = t.truth AND s.bin = b.bin GROUP BY 1, 2", "scored")
def a26(spark, d):
    from lodestar.operators.metrics import histogram

    return histogram(scored(spark, d), "p", "truth", 32)


@query("a27_split_sizes", "SELECT count(*) FILTER (split = 'TRAIN') AS train, count(*) FILTER (split = 'VALIDATION') AS validation, count(*) FILTER (split = 'TEST') AS test FROM state", "state")
def a27(spark, d):
    return state(spark, d).agg(*(F.count_if(F.col("split") == s).alias(s.lower()) for s in ("TRAIN", "VALIDATION", "TEST")))


@query("a28_run_medians", "SELECT user_id, median(value) AS median, min(value) AS least FROM events GROUP BY 1")
def a28(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.median("value").alias("median"), F.min("value").alias("least"))


# Windows


@query("w01_row_numbers", "SELECT patch_id, row_index FROM indexed", "patches indexed")
def w01(spark, d):
    return indexed(spark, d).select("patch_id", "row_index")


@query("w10_longest_error_run", "SELECT user_id, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE event_type = 'error' GROUP BY 1, 2) GROUP BY 1")
def w10(spark, d):
    e = read(spark, d, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return e.withColumn("k", k).where("event_type = 'error'").groupBy("user_id", "k").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("w11_round_robin", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS turn FROM embeddings")
def w11(spark, d):
    t = rel.interleaved(read(spark, d, "embeddings"), "label", ["vec_id"])
    return t.select("vec_id", "label", F.col("position._rn").cast("long").alias("turn"))


@query("w12_class_interleave", "SELECT patient_id, label, row_number() OVER (PARTITION BY label ORDER BY patient_id) * 2 - label AS position FROM (SELECT patient_id, max(label) AS label FROM patches GROUP BY 1)", "patches")
def w12(spark, d):
    g = patches(spark, d).groupBy("patient_id").agg(F.max("label").alias("label"))
    t = rel.interleaved(g, "label", ["patient_id"], "at")
    return t.select("patient_id", "label", (F.col("at._rn") * 2 - F.col("label")).cast("long").alias("position"))


@query("w13_run_detection", "SELECT patient_id, min(row_index) AS first, max(row_index) + 1 AS past, count(*) AS length FROM (SELECT patient_id, row_index, row_index - row_number() OVER (PARTITION BY patient_id ORDER BY row_index) AS k FROM indexed WHERE label = 0) GROUP BY patient_id, k", "patches indexed")
def w13(spark, d):
    return rel.islands(indexed(spark, d).where("label = 0"), "patient_id", "row_index")


@query("w14_slice_offsets", "SELECT patient_id, (sum(n) OVER (ORDER BY patient_id) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY patient_id))::BIGINT AS stop FROM (SELECT patient_id, count(*) AS n FROM patches GROUP BY 1)", "patches")
def w14(spark, d):
    return rel.offsets(patches(spark, d), "patient_id")


# Sorts and top-k


@query("o01_stable_sort", "SELECT label, patient_id, filename, patch_id FROM patches ORDER BY 1, 2, 3, 4", "patches")
def o01(spark, d):
    return patches(spark, d).select("label", "patient_id", "filename", "patch_id").orderBy("label", "patient_id", "filename", "patch_id")


@query("o02_worst_k", "SELECT patch_id, score FROM patches ORDER BY score, patch_id LIMIT 25", "patches")
def o02(spark, d):
    return patches(spark, d).select("patch_id", "score").orderBy("score", "patch_id").limit(25)


@query("o03_top_ratio", "SELECT patient_id, patch_id FROM (SELECT patient_id, patch_id, row_number() OVER (PARTITION BY patient_id ORDER BY score DESC, patch_id) AS rn, count(*) OVER (PARTITION BY patient_id) AS n FROM patches) WHERE rn <= least(greatest(round_even(0.25::DOUBLE * n, 0), 2), n)", "patches")
def o03(spark, d):
    from lodestar.operators.selection import top_ratio

    return top_ratio(patches(spark, d), "patient_id", "score", "patch_id", 0.25, 2).select("patient_id", "patch_id")


@query("o04_lexicographic_max", "SELECT p_brand, p_type, p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_type DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def o04(spark, d):
    top = F.max(F.struct("p_size", "p_type", (-F.col("p_partkey")).alias("k"))).alias("m")
    return read(spark, d, "part").groupBy("p_brand").agg(top).select("p_brand", "m.p_type", "m.p_size", (-F.col("m.k")).alias("p_partkey"))


@query("o05_near_far_mix", "SELECT label, vec_id, CASE WHEN a <= 3 THEN 'near' ELSE 'far' END AS kind FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY s, vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS b FROM (SELECT label, vec_id, round(embedding[1]::DOUBLE, 6) AS s FROM embeddings)) WHERE a <= 3 OR b <= 2")
def o05(spark, d):
    e = read(spark, d, "embeddings").select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("s"))
    a, b = (F.row_number().over(Window.partitionBy("label").orderBy(k, "vec_id")) for k in (F.asc("s"), F.desc("s")))
    return e.withColumns({"a": a, "b": b}).where("a <= 3 or b <= 2").select("label", "vec_id", F.when(F.col("a") <= 3, "near").otherwise("far").alias("kind"))


@query("o06_coverage_rank", "SELECT vec_id, c FROM (SELECT vec_id, round(list_sum(embedding)::DOUBLE, 3) AS c FROM embeddings) ORDER BY c DESC, vec_id LIMIT 20")
def o06(spark, d):
    e = read(spark, d, "embeddings")
    c = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 3)
    return e.select("vec_id", c.alias("c")).orderBy(F.desc("c"), "vec_id").limit(20)


@query("o07_capped_examples", "SELECT p_brand, array_to_string(list_slice(list(p_name ORDER BY p_name), 1, 3), '|') AS examples FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY 1")
def o07(spark, d):
    g = read(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("v"))
    return g.select("p_brand", F.array_join(F.slice("v", 1, 3), "|").alias("examples"))


@query("o08_registry_order", "SELECT p_partkey, row_number() OVER (ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_retailprice DESC, p_partkey) AS position FROM part WHERE p_size = 11")
def o08(spark, d):
    kind = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2)
    w = Window.orderBy(kind, F.desc("p_retailprice"), "p_partkey")  # a registry is short
    return read(spark, d, "part").where("p_size = 11").select("p_partkey", F.row_number().over(w).cast("long").alias("position"))


@query("o09_phase_order", "SELECT event_type, round(sum(value), 6) AS seconds FROM events GROUP BY 1 ORDER BY 2 DESC")
def o09(spark, d):
    return rel.phase_profile(read(spark, d, "events"), "event_type", "value").select("event_type", "seconds").orderBy(F.desc("seconds"))


# Set operations


@query("t01_bag_union", "SELECT patch_id, split FROM state WHERE split = 'TEST' UNION ALL SELECT patch_id, split FROM state WHERE split = 'TRAIN' UNION ALL SELECT patch_id, split FROM state WHERE split = 'TEST' AND is_selected = 1", "state")
def t01(spark, d):
    s = state(spark, d)
    part = lambda c: s.where(c).select("patch_id", "split")
    return part("split = 'TEST'").unionByName(part("split = 'TRAIN'")).unionByName(part("split = 'TEST' and is_selected = 1"))


@query("t02_difference_both_ways", "SELECT *, 'left' AS side FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12) UNION ALL SELECT *, 'right' FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 12 EXCEPT SELECT o_custkey FROM orders)")
def t02(spark, d):
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return rel.difference_both_ways(a, read(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("k")))


@query("t03_train_and_validation", "SELECT p.patient_id FROM patches p JOIN state USING (patch_id) WHERE split = 'TRAIN' INTERSECT SELECT p.patient_id FROM patches p JOIN state USING (patch_id) WHERE split = 'VALIDATION' OR label = 1", "patches state")
def t03(spark, d):
    j = patches(spark, d).join(state(spark, d), "patch_id")
    return j.where("split = 'TRAIN'").select("patient_id").intersect(j.where("split = 'VALIDATION' or label = 1").select("patient_id"))


@query("t04_key_union", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity < 2 GROUP BY 1) b ON a.k = b.k")
def t04(spark, d):
    li = read(spark, d, "lineitem")
    g = lambda c, n: li.where(c).groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias(n))
    return g("l_quantity > 49", "n_a").join(g("l_quantity < 2", "n_b"), "k", "full_outer").fillna(0, ["n_a", "n_b"])


@query("t05_unlisted", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def t05(spark, d):
    return read(spark, d, "orders").select("o_orderkey").join(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("t06_invalid_values", "SELECT DISTINCT o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def t06(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderstatus").alias("value")).distinct().where(~F.col("value").isin("F", "O"))


@query("t07_order_preserving_dedup", "SELECT user_id, min(event_id) AS position FROM events GROUP BY 1")
def t07(spark, d):
    return rel.sorted_dedup(read(spark, d, "events").withColumnRenamed("event_id", "position"), "user_id", "position")

"""Queries over files that the query itself writes: sources, sinks, the run store, and coerced columns.

Tables that grow are written by Spark. The small files of sources that hold one document each are
one for each nation or region, so there are as many at every size.
"""

from __future__ import annotations

import json
import sqlite3
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import coerce
from lodestar.operators.state import insert_if_absent
from lodestar.plans.base import patches, query, read, state
from lodestar.sources import datasources, readers, runs, scratch, writers


def _each(spark: SparkSession, d: str, name: Callable[[Row], str | None], text: Callable[[Row], str], table: str = "nation") -> str:
    """A folder with a file for each nation or region; name None: no file."""
    at = scratch.folder(spark)
    for r in read(spark, d, table).collect():
        if name(r):
            scratch.put(spark, f"{at}/{name(r)}", text(r))
    return at


def _box(x: int, points: int = 4) -> list[list[int]]:
    return [[x, 0], [x + 2, 0], [x + 2, 1], [x, 1]][:points]


def _summed(rings: DataFrame) -> DataFrame:
    """One row a ring: what identifies it."""
    x = F.transform("ring", lambda p: p["x"])
    return rings.select(readers.stem_of(F.col("path")).alias("stem"), "class", F.size("ring").cast("long").alias("n_points"), F.array_min(x).alias("min_x"), F.array_max(x).alias("max_x"), F.array_max(F.transform("ring", lambda p: p["y"])).alias("max_y"))


# Sources


@query("s04_format_dispatch", "SELECT o_orderkey, o_custkey, o_totalprice, CASE o_orderkey % 4 WHEN 0 THEN 'parquet' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' ELSE 'orc' END AS suffix FROM orders")
def s04(spark, d):
    o, at, out = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), scratch.folder(spark), None
    for i, kind in enumerate(("parquet", "csv", "json", "orc")):
        o.where(F.col("o_orderkey") % 4 == i).write.format(kind).option("header", "true").save(f"{at}/orders.{kind}")
        part = readers.read_table(spark, f"{at}/orders.{kind}", o.schema).withColumn("suffix", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("s05_case_listing", "SELECT 'nation_' || n_nationkey AS stem, CASE WHEN n_nationkey % 2 = 0 THEN '.svs' ELSE '.tif' END AS suffix, CAST(length(n_name) AS BIGINT) AS length FROM nation")
def s05(spark, d):
    at = _each(spark, d, lambda r: f"case_{r.n_regionkey}/nation_{r.n_nationkey}.{'tif' if r.n_nationkey % 2 else 'SVS'}", lambda r: r.n_name)
    return readers.list_files(spark, at).select("stem", "suffix", "length")


def _archive(spark: SparkSession, d: str, content: Callable[[Row], str]) -> str:
    datasources.register(spark)
    path = f"{scratch.local(scratch.folder(spark))}/slides.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in read(spark, d, "nation").collect():
            z.writestr(zipfile.ZipInfo(f"case/nation_{r.n_nationkey}.{'txt' if r.n_nationkey % 5 == 0 else 'svs'}"), content(r))
    return path


@query("s06_zip_members", "SELECT 'case/nation_' || n_nationkey || '.svs' AS member, CAST(length(n_name) AS BIGINT) AS length, n_nationkey % 2 = 1 AS changed FROM nation WHERE n_nationkey % 5 <> 0")
def s06(spark, d):
    before, after = (spark.read.format("zip_members").option("path", _archive(spark, d, f)).option("suffixes", ".svs").load() for f in (lambda r: r.n_name, lambda r: r.n_name.lower() if r.n_nationkey % 2 else r.n_name))
    return before.join(after.select("member", F.col("signature").alias("later")), "member").select("member", "length", (F.col("signature") != F.col("later")).alias("changed"))


@query("s07_zip_extract", "SELECT 'case/nation_' || n_nationkey || '.svs' AS member, n_name AS content FROM nation WHERE n_nationkey % 5 <> 0")
def s07(spark, d):
    members = spark.read.format("zip_members").option("path", _archive(spark, d, lambda r: r.n_name)).option("suffixes", ".svs").option("content", "true").load()
    return members.select("member", F.decode("content", "UTF-8").alias("content"))


@query("s08_geojson_index", "SELECT 'nation_' || n_nationkey AS stem, n_nationkey % 5 <> 0 AS found, n_nationkey % 5 = 0 AS ambiguous FROM nation")
def s08(spark, d):
    at = _each(spark, d, lambda r: f"nation_{r.n_nationkey}__ab.geojson", lambda r: "{}")
    for r in read(spark, d, "nation").where("n_nationkey % 5 = 0").collect():
        scratch.put(spark, f"{at}/nation_{r.n_nationkey}.geojson", "{}")
    return readers.geojson_index(readers.list_files(spark, at)).select("stem", F.col("path").isNotNull().alias("found"), "ambiguous")


def _features(r: Row) -> str:
    k = r.n_nationkey
    one = {"properties": {"classification": "Fold"}, "geometry": {"type": "Polygon", "coordinates": [_box(k), _box(99)]}}
    many = {"properties": {"classification": {"name": "Fold"}}, "geometry": {"type": "MultiPolygon", "coordinates": [[_box(k)], [_box(k + 10)]]}}
    other = {"properties": {"classification": "Other"}, "geometry": {"type": "Polygon", "coordinates": [_box(0)]}}
    return "{broken" if k == 7 else json.dumps({"features": [many if k % 2 else one, other]})


@query(
    "s09_geojson_polygons",
    """SELECT 'nation_' || n_nationkey AS stem, 'Fold' AS class, CAST(4 AS BIGINT) AS n_points, CAST(n_nationkey + more AS DOUBLE) AS min_x, CAST(n_nationkey + more + 2 AS DOUBLE) AS max_x, CAST(1 AS DOUBLE) AS max_y
    FROM nation CROSS JOIN (VALUES (0), (10)) AS t(more) WHERE n_nationkey <> 7 AND (more = 0 OR n_nationkey % 2 = 1)""",
)
def s09(spark, d):
    return _summed(readers.geojson_polygons(spark, _each(spark, d, lambda r: f"nation_{r.n_nationkey}.geojson", _features), ["Fold"]))


_TRIANGLES = "SELECT 'nation_' || n_nationkey AS stem, {kind} AS class, CAST({points} AS BIGINT) AS n_points, CAST(n_nationkey AS DOUBLE) * {scale} AS min_x, CAST(n_nationkey + 2 AS DOUBLE) * {scale} AS max_x, CAST(1 AS DOUBLE) * {scale} AS max_y FROM nation{where}"


def _vertices(tag: str, ring: list[list[int]]) -> str:
    return "".join(f'<{tag} X="{x}" Y="{y}"/>' for x, y in ring)


@query("s10_xml_regions", _TRIANGLES.format(kind="CASE WHEN n_nationkey % 2 = 0 THEN 'cancer' ELSE 'normal' END", points=3, scale=1, where=" WHERE n_nationkey % 5 <> 0"))
def s10_regions(spark, d):
    def text(r: Row) -> str:
        colour = "7" if r.n_nationkey % 5 == 0 else "65280" if r.n_nationkey % 2 else "255"
        inner = "".join(f"<Region>{_vertices('Vertex', _box(r.n_nationkey, n))}</Region>" for n in (3, 2))
        return f'<A><Annotation LineColor="{colour}"><Regions>{inner}</Regions></Annotation></A>'

    return _summed(readers.xml_regions(spark, _each(spark, d, lambda r: f"nation_{r.n_nationkey}.xml", text), {"255": "cancer", "65280": "normal"}))


@query("s10_xml_coordinates", _TRIANGLES.format(kind="'cancer'", points=4, scale=4, where=" WHERE n_nationkey % 2 = 0"))
def s10_coordinates(spark, d):
    text = lambda r: f'<A><Annotation Color="{"#000000" if r.n_nationkey % 2 else " f4fa58"}"><Coordinates>{_vertices("Coordinate", _box(r.n_nationkey))}</Coordinates></Annotation></A>'
    return _summed(readers.xml_coordinates(spark, _each(spark, d, lambda r: f"nation_{r.n_nationkey}.xml", text), {"#F4FA58": "cancer"}, 4.0))


@query("s11_ndpa_regions", "SELECT 'nation_' || n_nationkey AS stem, 'cancer' AS class, CAST(3 AS BIGINT) AS n_points, CAST(n_nationkey + 50 AS DOUBLE) AS min_x, CAST(n_nationkey + 52 AS DOUBLE) AS max_x, CAST(101 AS DOUBLE) AS max_y FROM nation WHERE n_nationkey % 3 <> 0")
def s11(spark, d):
    def text(r: Row) -> str:
        points = [*((x * 250, y * 250) for x, y in _box(r.n_nationkey, 3)), ("bad", 1)]
        inner = "".join(f"<point><x>{x}</x><y>{y}</y></point>" for x, y in points)
        return f"<r><ndpviewstate><title> {'T' if r.n_nationkey % 3 else 'other'} </title><annotation><pointlist>{inner}</pointlist></annotation></ndpviewstate></r>"

    return _summed(readers.ndpa_regions(spark, _each(spark, d, lambda r: f"nation_{r.n_nationkey}.ndpa", text), {"T": "cancer"}, size=(100, 200)))


@query("s12_json_regions", _TRIANGLES.format(kind="CASE WHEN n_nationkey % 2 = 0 THEN 'cancer' ELSE 'other' END", points=4, scale=1, where=""))
def s12(spark, d):
    fields = ["cancer_polygons", "not_cancer_polygons"]
    text = lambda r: json.dumps({fields[r.n_nationkey % 2]: [_box(r.n_nationkey), _box(0, 2)], fields[1 - r.n_nationkey % 2]: []})
    return _summed(readers.json_regions(spark, _each(spark, d, lambda r: f"nation_{r.n_nationkey}.json", text), dict(zip(fields, ["cancer", "other"], strict=True))))


@query(
    "s13_handler_dispatch",
    """SELECT p_partkey, CASE WHEN i = '.svs' AND a = '.xml' THEN 'xml' WHEN i = '.ndpi' AND a = '.ndpa' THEN 'ndpa' WHEN i IN ('.svs', '.tif') AND a = '.json' THEN 'json' END AS handler
    FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.svs' WHEN 1 THEN '.ndpi' WHEN 2 THEN '.tif' ELSE '' END AS i, CASE p_partkey % 3 WHEN 0 THEN '.xml' WHEN 1 THEN '.ndpa' ELSE '.json' END AS a FROM part)""",
)
def s13(spark, d):
    suffix = lambda names: F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    pairs = read(spark, d, "part").select("p_partkey", F.concat(F.lit("a/b.c/slide"), suffix([".SVS", ".ndpi", ".tif", ""])).alias("image"), F.concat(F.lit("slide"), suffix([".xml", ".NDPA", ".json"])).alias("annotation"))
    return readers.with_handler(pairs, "image", "annotation").select("p_partkey", "handler")


_SPLIT_ROWS = "SELECT split, label, patient_id, filename, patch_id FROM patches JOIN state USING (patch_id) WHERE split IS NOT NULL"


def _split_rows(spark: SparkSession, d: str) -> DataFrame:
    return patches(spark, d).join(state(spark, d).where("split is not null"), "patch_id").select("split", "label", "patient_id", "filename", "patch_id")


@query("s15_split_manifest", f"SELECT 'run' AS run_id, split, label, patient_id, filename, patch_id % 2 = 0 AS is_normalized, patch_id AS source_row_index FROM ({_SPLIT_ROWS})", "patches state")
def s15(spark, d):
    at = f"{scratch.folder(spark)}/split_manifest.csv"
    none, text = F.lit(None).cast("string"), F.lit("a, \"b\"")
    _split_rows(spark, d).select(F.lit("run").alias("run_id"), "split", "label", "patient_id", "filename", none.alias("normalization_method"), (F.col("patch_id") % 2 == 0).alias("is_normalized"), text.alias("source_hdf5_path"), F.col("patch_id").alias("source_row_index"), none.alias("source_image_path"), none.alias("source_mask_path")).write.option("header", "true").option("escape", '"').csv(at)
    return readers.split_manifest(spark, at).select("run_id", "split", "label", "patient_id", "filename", "is_normalized", "source_row_index")


@query("s15_split_stats", f"SELECT split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, CASE split WHEN 'TRAIN' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS planned, CAST(7 AS BIGINT) AS seed FROM ({_SPLIT_ROWS}) GROUP BY split", "patches state")
def s15_stats(spark, d):
    at = scratch.folder(spark)
    _split_rows(spark, d).groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("label").alias("positives")).write.option("header", "true").csv(f"{at}/split_stats.csv")
    scratch.put(spark, f"{at}/run_config.json", json.dumps({"seed": 7, "fractions": {"TRAIN": 0.6, "VALIDATION": 0.2, "TEST": 0.2}}, indent=1))
    stats = readers.split_stats(spark, f"{at}/split_stats.csv", "split string, n_rows long, positives long")
    config = readers.run_config(spark, f"{at}/run_config.json", "seed long, fractions map<string,double>")
    planned = config.select("seed", F.explode("fractions").alias("split", "planned"))
    return stats.join(F.broadcast(planned), "split").select("split", "n_rows", "positives", "planned", "seed")


@query("s16_review_records", "SELECT 'f' || n_nationkey AS file_name, 'region ' || n_regionkey AS origin, n_name AS subject, CASE WHEN n_nationkey % 2 = 1 THEN 'include' END AS final_verdict FROM nation ORDER BY origin, file_name")
def s16(spark, d):
    datasources.register(spark)
    path = f"{scratch.local(scratch.folder(spark))}/review.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE review_files (id INTEGER PRIMARY KEY, file_name TEXT, file_path TEXT, origin TEXT, subject TEXT, process_status TEXT, markdown_path TEXT, final_verdict TEXT, comments TEXT)")
        rows = [(f"f{r.n_nationkey}", "p", f"region {r.n_regionkey}", r.n_name, "DONE", None, "include" if r.n_nationkey % 2 else None, None) for r in read(spark, d, "nation").collect()]
        db.executemany("INSERT INTO review_files (file_name, file_path, origin, subject, process_status, markdown_path, final_verdict, comments) VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    return readers.review_records(spark, path).select("file_name", "origin", "subject", "final_verdict")


@query(
    "s17_protocol_blocks",
    """SELECT 'region_' || r_regionkey AS stem, kind, line FROM region CROSS JOIN (VALUES ('question', 'RQ1: what?'), ('question', 'RQ2: why?'), ('included', 'NAME'), ('included', 'b'), ('excluded', 'c'), ('query', 'a AND b')) AS t(kind, line0)
    CROSS JOIN LATERAL (SELECT CASE WHEN line0 = 'NAME' THEN r_name ELSE line0 END AS line)""",
)
def s17(spark, d):
    text = lambda r: f"# Plan\nRQ1: what? \nRQ2: why?\nnot RQ\nInclusion Criteria:\n\n {r.r_name} \nb\nExclusion Criteria:\n c\n3. Databases and Exact Search Queries\nFirst library:\n\n  a AND b\n"
    at = _each(spark, d, lambda r: f"region_{r.r_regionkey}.md", text, "region")
    # These marker lines are the document's format; fixed values.
    parts = {
        "question": readers.lines_starting(spark, at, "RQ"),
        "included": readers.lines_between(spark, at, "Inclusion Criteria:", "Exclusion Criteria:"),
        "excluded": readers.lines_between(spark, at, "Exclusion Criteria:", "3. Databases and Exact Search Queries"),
        "query": readers.lines_after(spark, at, {"First library:": "first"}),
    }
    out = None
    for kind, lines in parts.items():
        part = lines.select(readers.stem_of(F.col("path")).alias("stem"), F.lit(kind).alias("kind"), "line")
        out = part if out is None else out.unionByName(part)
    return out


@query("s18_model_candidates", "SELECT 'UNET' AS architecture, 'e' || n_nationkey AS encoder, CAST(n_nationkey AS DOUBLE) / 4 AS best FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0")
def s18(spark, d):
    text = lambda r: json.dumps({"architecture": "fpn" if r.n_nationkey % 2 else "Unet", "encoder": f"e{r.n_nationkey}", "checkpoint_path": "c", "best": r.n_nationkey / 4 if r.n_nationkey % 5 else None})
    return readers.model_candidates(spark, _each(spark, d, lambda r: f"m{r.n_nationkey}_meta.json", text), "best", ["unet"]).select("architecture", "encoder", "best")


@query("s19_review_labels", "SELECT 'nation_' || n_nationkey AS stem, CASE WHEN n_nationkey % 3 = 0 THEN 'Rejected' ELSE 'Approved' END AS label FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0")
def s19(spark, d):
    folders = [_each(spark, d, lambda r, n=n: None if r.n_nationkey % n else f"nation_{r.n_nationkey}.png", lambda r: "x") for n in (2, 3)]
    return readers.review_labels(*(readers.list_files(spark, at) for at in folders))


# Sinks


@query("k01_shard_writer", "SELECT o_orderkey, CASE WHEN o_custkey % 7 IN (1, 2) THEN o_totalprice * 2 ELSE o_totalprice END AS price, CAST(o_custkey % 7 AS BIGINT) AS shard FROM orders WHERE o_custkey % 7 <> 3")
def k01(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 7).alias("shard"))
    at = f"{scratch.folder(spark)}/shards"
    writers.write_shards(rows, at, "shard")
    writers.write_shards(rows.where("shard in (1, 2)").withColumn("price", F.col("price") * 2), at, "shard")
    writers.drop_shards(spark, at, "shard", ["3"])
    return spark.read.schema("o_orderkey long, price double, shard long").parquet(at)


@query("k05_split_writer", _SPLIT_ROWS, "patches state")
def k05(spark, d):
    rows, at = _split_rows(spark, d), f"{scratch.folder(spark)}/splits"
    writers.write_splits(rows, at, "split", ["patch_id"])
    return spark.read.schema(rows.schema).parquet(at)


@query("k06_selected_store", "SELECT patch_id, patient_id, filename FROM patches JOIN state USING (patch_id) WHERE is_selected = 1", "patches state")
def k06(spark, d):
    rows, at = patches(spark, d).select("patch_id", "patient_id", "filename"), f"{scratch.folder(spark)}/selected"
    writers.publish(rows, at, ["patch_id"])
    writers.publish(rows.join(state(spark, d).where("is_selected = 1"), "patch_id").select(rows.columns), at, ["patch_id"])
    return readers.read_table(spark, at)


@query("k07_artifact_index", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 3 <> 2")
def k07(spark, d):
    rows, at = read(spark, d, "orders").select("o_orderkey", "o_orderdate"), f"{scratch.folder(spark)}/index"
    for part in (rows.limit(0), rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 3 = 1")):
        writers.append_index(part, at)
    return readers.read_table(spark, at)


@query("k08_decision_csv", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN 'a, \"b\"' END AS note FROM orders GROUP BY 1, 2")
def k08(spark, d):
    n = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    at = f"{scratch.folder(spark)}/decisions.csv"
    writers.write_report(n.withColumn("note", F.when(F.col("n") % 2 == 0, 'a, "b"')), at)
    return readers.read_table(spark, at, "status string, priority string, n long, note string")


@query("k09_manifest_json", "SELECT 'shard_' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'new' END AS digest FROM nation UNION ALL SELECT 'shard_more', 'new'")
def k09(spark, d):
    name = F.concat(F.lit("shard_"), F.col("n_nationkey").cast("string")).alias("name")
    old, at = read(spark, d, "nation").select(name, F.col("n_name").alias("digest")), f"{scratch.folder(spark)}/manifest.json"
    changed = read(spark, d, "nation").where("n_nationkey % 2 = 1").select(name, F.lit("new").alias("digest")).unionByName(spark.createDataFrame([("shard_more", "new")], "name string, digest string"))
    writers.write_report(writers.upsert_manifest(old, changed, "name"), at, "json")
    return readers.read_table(spark, at, "name string, digest string")


# State


@query(
    "u03_sampling_run",
    """SELECT patch_id, CASE WHEN patch_id % 2 = 0 THEN CASE WHEN patch_id % 4 = 0 THEN 1 ELSE 0 END ELSE is_selected END AS selected,
    CASE WHEN patch_id % 2 = 0 THEN 'sampling' ELSE 'splits' END AS last_stage, CAST(1 AS BIGINT) AS run_id FROM state""",
    "state",
)
def u03(spark, d):
    """One run is recorded; a second, of a patch that is not there, fails and leaves all as it was."""
    at = f"{scratch.folder(spark)}/store"
    runs.create_store(state(spark, d).select("patch_id", F.col("is_selected").alias("selected"), F.lit("splits").alias("last_stage")), at)
    decided = state(spark, d).where("patch_id % 2 = 0").select("patch_id", (F.col("patch_id") % 4 == 0).cast("int").alias("selected"))
    runs.record_run(spark, at, "sampling", decided, "patch_id")
    strange = spark.createDataFrame([(-1, 1)], "patch_id long, selected int")
    try:
        runs.record_run(spark, at, "sampling", insert_if_absent(decided, strange, ["patch_id"]), "patch_id")
    except ValueError:
        recorded, now = runs.read_store(spark, at)
        top = recorded.agg(F.max("run_id").alias("run_id"))
        return now.crossJoin(F.broadcast(top)).select("patch_id", "selected", "last_stage", "run_id")
    raise AssertionError("a decision on no patch was taken")


# Functions


@query("f36_iso_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def f36(spark, d):
    return read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("f37_counter_maps", "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) AS events, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def f37(spark, d):
    n = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("user_id", F.coalesce(F.try_element_at("m", F.lit("error")), F.lit(0)).cast("long").alias("errors"), total.alias("events"), F.size("m").cast("long").alias("kinds"))


@query(
    "f40_background_rate",
    """WITH seg AS (SELECT l_suppkey, sum(l_quantity) AS total, count(*) AS pixels FROM lineitem GROUP BY 1)
    SELECT l_orderkey, count(*) FILTER (total < 25 * pixels AND l_linestatus = 'F') AS background, count(*) FILTER (l_linestatus = 'F') AS roi,
    CASE WHEN count(*) FILTER (l_linestatus = 'F') > 0 THEN CAST(count(*) FILTER (total < 25 * pixels AND l_linestatus = 'F') AS DOUBLE) / count(*) FILTER (l_linestatus = 'F') END AS rate
    FROM lineitem JOIN seg USING (l_suppkey) GROUP BY 1""",
)
def f40(spark, d):
    """Segments (suppliers) of a low mean are background; per image its share of the region of interest."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linestatus")
    segments = li.groupBy("l_suppkey").agg((F.sum("l_quantity") < 25 * F.count("*")).alias("is_background"))
    roi = F.col("l_linestatus") == "F"
    n = li.join(segments, "l_suppkey").groupBy("l_orderkey").agg(F.count_if(roi & F.col("is_background")).alias("background"), F.count_if(roi).alias("roi"))
    return n.withColumn("rate", F.when(F.col("roi") > 0, F.col("background") / F.col("roi")))


@query("f43_coercion", "SELECT o_orderkey AS patch_id, o_totalprice AS price, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS rate, o_orderkey % 2 = 0 AS flag FROM orders")
def f43(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    flag = F.when(key % 4 == 0, " Yes").when(key % 4 == 2, "T").when(key % 4 == 1, "on")
    return read(spark, d, "orders").select(
        coerce.as_int(F.concat(F.lit(" "), key.cast("string")), "patch_id").alias("patch_id"),
        coerce.as_float(price, "price").alias("price"),
        coerce.as_float_or_null(F.when(key % 3 != 0, price), "rate").alias("rate"),
        coerce.as_bool(flag).alias("flag"),
    )

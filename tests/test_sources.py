"""Readers, data sources, sinks and streams over temporary files."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.functions import coerce
from lodestar.sources import datasources, readers, runs, scratch, writers
from lodestar.streaming import accumulators


def test_sqlite_and_zip(spark, tmp_path):
    datasources.register(spark)
    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE patches (patch_id INTEGER PRIMARY KEY, name TEXT, cover REAL)")
        db.executemany("INSERT INTO patches VALUES (?, ?, ?)", [(i, f"p{i}" if i % 3 else None, i / 2) for i in range(1, 41)])
    t = spark.read.format("sqlite").option("path", path).option("table", "patches").option("partitions", "3").load()
    assert t.dtypes == [("patch_id", "bigint"), ("name", "string"), ("cover", "double")]
    assert t.count() == 40 and t.where("name is null").count() == 13
    archive = str(tmp_path / "a.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for n in ("b/2.svs", "a/1.SVS", "c.txt"):
            z.writestr(n, n * 3)
    m = spark.read.format("zip_members").option("path", archive).option("suffixes", ".svs,.tif").option("content", "true").load().orderBy("member").collect()
    assert [r.member for r in m] == ["a/1.SVS", "b/2.svs"] and bytes(m[1].content) == b"b/2.svs" * 3 and len({r.signature for r in m}) == 2


def test_annotations(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<A><Annotation LineColor="255"><Regions><Region><Vertex X="0" Y="0"/><Vertex X="1" Y="0"/><Vertex X="1" Y="1"/></Region><Region><Vertex X="0" Y="0"/></Region></Regions></Annotation><Annotation LineColor="7"/></A>')
    r = readers.xml_regions(spark, str(tmp_path / "x.xml"), {"255": "cancer"}).collect()
    assert len(r) == 1 and r[0]["class"] == "cancer" and len(r[0]["ring"]) == 3
    (tmp_path / "h.xml").write_text('<A><Annotation Color=" f4fa58"><Coordinates><Coordinate X="1" Y="2"/><Coordinate X="3" Y="2"/><Coordinate X="3" Y="4"/></Coordinates></Annotation></A>')
    h = readers.xml_coordinates(spark, str(tmp_path / "h.xml"), {"#F4FA58": "cancer"}, 4.0).collect()
    assert (h[0].ring[0].x, h[0].ring[0].y) == (4.0, 8.0)
    (tmp_path / "n.ndpa").write_text("<r><ndpviewstate><title> T </title><annotation><pointlist>" + "".join(f"<point><x>{x}</x><y>{y}</y></point>" for x, y in [(0, 0), (250, 0), (250, 250), ("bad", 1)]) + "</pointlist></annotation></ndpviewstate></r>")
    n = readers.ndpa_regions(spark, str(tmp_path / "n.ndpa"), {"T": "cancer"}, size=(100, 100)).collect()
    assert [(p.x, p.y) for p in n[0].ring] == [(50, 50), (51, 50), (51, 51)]
    (tmp_path / "j.json").write_text(json.dumps({"cancer_polygons": [[[0, 0], [1, 0], [1, 1]], [[0, 0]]], "not_cancer_polygons": []}))
    j = readers.json_regions(spark, str(tmp_path / "j.json"), {"cancer_polygons": "cancer", "not_cancer_polygons": "other"}).collect()
    assert len(j) == 1 and len(j[0].ring) == 3
    features = [
        {"properties": {"classification": "Fold"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]], [[9, 9]]]}},
        {"properties": {"classification": {"name": "Fold"}}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]]}},
        {"properties": {"classification": "Other"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0]]]}},
    ]
    g = tmp_path / "g"
    g.mkdir()
    (g / "s__ab.geojson").write_text(json.dumps({"features": features}))
    (g / "bad.geojson").write_text("{not json")
    assert readers.geojson_polygons(spark, str(g), ["Fold"]).count() == 3
    (g / "s.geojson").write_text("{}")
    index = {r.stem: (r.path is not None, r.ambiguous) for r in readers.geojson_index(readers.list_files(spark, str(g))).collect()}
    assert index == {"s": (False, True), "bad": (True, False)}
    pairs = spark.createDataFrame([("a.SVS", "a.xml"), ("a.ndpi", "a.xml")], "i string, a string")
    assert [r.handler for r in readers.with_handler(pairs, "i", "a").collect()] == ["xml", None]


def test_protocol_and_labels(spark, tmp_path):
    (tmp_path / "p.md").write_text("x\nInclusion Criteria:\n\n a \nb\nExclusion Criteria:\nc\n")
    assert [r.line for r in readers.lines_between(spark, str(tmp_path / "p.md"), "Inclusion Criteria:", "Exclusion Criteria:").orderBy("line_number").collect()] == ["a", "b"]
    a = spark.createDataFrame([("s1",), ("s2",)], "stem string")
    b = spark.createDataFrame([("s2",)], "stem string")
    assert {r.stem: r.label for r in readers.review_labels(a, b).collect()} == {"s1": "Approved", "s2": "Rejected"}
    d = tmp_path / "models"
    d.mkdir()
    for i, (arch, score) in enumerate([("unet", 0.5), ("fpn", None), ("unet", 0.7)]):
        (d / f"m{i}_meta.json").write_text(json.dumps({"architecture": arch, "encoder": "e", "checkpoint_path": "c", "best": score}))
    assert readers.model_candidates(spark, str(d), "best", ["UNet"]).count() == 2


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, shard string")
    path = str(tmp_path / "t")
    writers.write_shards(t, path, "shard")
    writers.write_shards(spark.createDataFrame([(3, "c", "y")], "k long, v string, shard string"), path, "shard")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 3]
    writers.drop_shards(spark, path, "shard", ["y"])
    assert [r.k for r in spark.read.parquet(path).collect()] == [1]
    out = str(tmp_path / "o.parquet")
    assert writers.publish(t, out, ["k"]) == 2
    with pytest.raises(ValueError):
        writers.publish(t.unionByName(t), out, ["k"])
    assert writers.same_rows(readers.read_table(spark, out), t)
    writers.append_index(t.limit(0), str(tmp_path / "i"))
    assert readers.read_table(spark, str(tmp_path / "i")).columns == t.columns
    writers.write_report(t, str(tmp_path / "r.csv"))
    assert readers.read_table(spark, str(tmp_path / "r.csv")).count() == 2
    assert [r.v for r in writers.upsert_manifest(t, spark.createDataFrame([(1, "z", "x")], t.schema), "k").collect()] == ["z", "b"]
    with pytest.raises(ValueError):
        readers.read_table(spark, "a.xyz")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, 0.9, 1), (1, 0.2, 0), (2, 0.7, 0)], "e long, p double, truth int")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    accumulators.run_once(accumulators.streaming_confusion(stream, "e", "p", "truth", 0.5), str(tmp_path / "c1"), "conf")
    assert {r.e: (r.tp, r.fp, r.fn, r.tn) for r in spark.table("conf").collect()} == {1: (1, 0, 0, 1), 2: (0, 1, 0, 0)}
    accumulators.run_once(accumulators.streaming_histogram(stream, "p", "truth", 4), str(tmp_path / "c2"), "hist")
    assert sum(r.n for r in spark.table("hist").collect()) == 3
    ev = spark.createDataFrame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:09:00", "a"), ("2024-01-01 01:00:00", "b")], "ts string, kind string").selectExpr("cast(ts as timestamp) ts", "kind")
    ev.write.parquet(str(tmp_path / "ev"))
    es = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    accumulators.run_once(accumulators.windowed_counts(es, "ts", "kind", "10 minutes", "5 minutes"), str(tmp_path / "c3"), "win", "append")
    assert [(r.kind, r.n) for r in spark.table("win").collect()] == [("a", 2)]


def test_run_store(spark, tmp_path):
    at = str(tmp_path / "store")
    state = spark.createDataFrame([(1, None, "a"), (2, 1, "a"), (3, 0, "a")], "k long, selected int, last_stage string")
    runs.create_store(state, at)
    assert runs.record_run(spark, at, "b", spark.createDataFrame([(1, 1), (2, 0)], "k long, selected int"), "k", ("c.json", "00")) == 1
    rows = {r.k: (r.selected, r.last_stage) for r in runs.read_store(spark, at)[1].collect()}
    assert rows == {1: (1, "b"), 2: (0, "b"), 3: (0, "a")}
    for bad in ([(1, 1), (2, 0), (9, 1)], [(1, 1)]):  # a key that is not there; a row that an earlier run of the stage has left
        with pytest.raises(ValueError):
            runs.record_run(spark, at, "b", spark.createDataFrame(bad, "k long, selected int"), "k")
        told, now = runs.read_store(spark, at)
        assert told.count() == 1 and {r.k: (r.selected, r.last_stage) for r in now.collect()} == rows
    assert runs.record_run(spark, at, "c", spark.createDataFrame([], "k long, selected int"), "k") == 2
    assert [tuple(r)[:4] for r in runs.read_store(spark, at)[0].orderBy("run_id").collect()] == [(1, "b", "c.json", "00"), (2, "c", None, None)]


def test_publish_survives_a_lost_driver(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    out = tmp_path / "o.parquet"
    writers.publish(t, str(out), ["k"])
    out.rename(tmp_path / "o.parquet.aside")  # as if it had ended between the two renames
    with pytest.raises(ValueError):
        writers.publish(t.unionByName(t), str(out), ["k"])
    assert writers.same_rows(readers.read_table(spark, str(out)), t)
    writers.publish(t.limit(1), str(out), ["k"])
    assert readers.read_table(spark, str(out)).count() == 1 and not (tmp_path / "o.parquet.aside").exists()


def test_missing_and_empty_documents(spark, tmp_path):
    assert readers.run_config(spark, str(tmp_path / "none.json"), "a long") is None
    assert readers.split_stats(spark, str(tmp_path / "none.csv"), "a long") is None
    (tmp_path / "s.csv").write_text("a\n")
    assert readers.split_stats(spark, str(tmp_path / "s.csv"), "a long") is None
    (tmp_path / "p.md").write_text("M1\n\n\nq 1\nM2\n")
    got = readers.lines_after(spark, str(tmp_path / "p.md"), {"M1": "one", "M2": "two"}).collect()
    assert [(r.name, r.line) for r in got] == [("one", "q 1")]
    with pytest.raises(ValueError):
        scratch.local("hdfs://host/a")
    assert scratch.local("file:///a/b") == scratch.local("/a/b") == "/a/b"


def test_coercion(spark):
    t = spark.createDataFrame([("7", None, " YES ")], "a string, b string, c string")
    r = t.select(coerce.as_int(F.col("a"), "a").alias("a"), coerce.as_float_or_null(F.col("b"), "b").alias("b"), coerce.as_bool(F.col("c")).alias("c"), coerce.as_bool(F.col("b"), True).alias("d"), coerce.as_bool(F.col("a")).alias("e")).first()
    assert tuple(r) == (7, None, True, True, False)
    for wrong in (coerce.as_int(F.col("b"), "b"), coerce.as_float(F.col("c"), "c"), coerce.as_float_or_null(F.col("c"), "c"), coerce.as_int(F.lit("1.5"), "x")):
        with pytest.raises(Exception, match="is not"):
            t.select(wrong).collect()

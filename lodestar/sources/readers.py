"""Readers: files to DataFrames. Whole-file formats are read in parallel as binary or text rows, one file a row."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar import ship
from lodestar.sources.scratch import filesystem

RING = "array<struct<x:double,y:double>>"
SPLIT_MANIFEST = "run_id string, split string, label int, patient_id long, filename string, normalization_method string, is_normalized boolean, source_hdf5_path string, source_row_index long, source_image_path string, source_mask_path string"


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def suffix_of(path: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(path, r"(\.[^./]*)$", 1), F.lit("")))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, stem, suffix, length of the files of a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", stem_of(F.col("path")).alias("stem"), suffix_of(F.col("path")).alias("suffix"), "length", "modificationTime")


def read_table(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A table by the suffix of its path: parquet (also folders), csv with header, json lines, orc."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", "true").option("enforceSchema", "false").csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return reader.json(path)
    if kind == "orc":
        return reader.orc(path)
    if kind in ("parquet", "pq") or "." not in path.rsplit("/", 1)[-1]:
        return reader.parquet(path)
    raise ValueError(f"no reader for .{kind}: {path}")


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The split manifest by its contract; never inferred."""
    return read_table(spark, path, SPLIT_MANIFEST)


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = filesystem(spark, path)
    return files.exists(at)


def run_config(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The run's JSON document as one row; None if there is none."""
    return spark.read.schema(schema).json(path, multiLine=True) if _exists(spark, path) else None


def split_stats(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The CSV of the splits' statistics; None if it is missing or has no rows."""
    stats = read_table(spark, path, schema) if _exists(spark, path) else None
    return None if stats is None or stats.isEmpty() else stats


def review_records(spark: SparkSession, path: str) -> DataFrame:
    """The files under review of a SQLite database, by origin and name. Register the data sources first."""
    names = ["file_name", "file_path", "origin", "subject", "process_status", "markdown_path", "final_verdict", "comments"]
    return spark.read.format("sqlite").option("path", path).option("table", "review_files").load().select(*names).orderBy("origin", "file_name")


def accepted_rows(manifest: DataFrame, index: str, position: str) -> DataFrame:
    """Accepted rows, of each index the first by position."""
    w = Window.partitionBy(index).orderBy(position)
    return manifest.where("decision = 'accepted'").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def geojson_index(files: DataFrame) -> DataFrame:
    """stem, path, ambiguous for files(path, stem, suffix): plain names and names stem__digest; two candidates are ambiguous and give no path."""
    g = files.where("suffix = '.geojson'").groupBy(F.split_part(F.col("stem"), F.lit("__"), F.lit(1)).alias("stem")).agg(F.array_sort(F.collect_list("path")).alias("p"))
    return g.select("stem", F.when(F.size("p") == 1, F.col("p")[0]).alias("path"), (F.size("p") > 1).alias("ambiguous"))


_FEATURES = "struct<features:array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>>"


def geojson_polygons(spark: SparkSession, path: str, classes: Sequence[str]) -> DataFrame:
    """path, class, ring: outer rings of polygons and multipolygons of the classes; a file that does not parse gives none.

    The class is a text or the name of a struct.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    f = raw.select("path", F.explode(F.from_json("t", _FEATURES)["features"]).alias("f"))
    name = F.coalesce(F.get_json_object("f.properties", "$.classification.name"), F.get_json_object("f.properties", "$.classification"))
    f = f.select("path", name.alias("class"), "f.geometry.type", "f.geometry.coordinates").where(F.col("class").isin(*classes))
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>")[0])
    many = F.transform(F.from_json("coordinates", "array<array<array<array<double>>>>"), lambda p: p[0])
    rings = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", many)
    points = F.transform("r", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select("path", "class", F.explode(rings).alias("r")).where("r is not null").select("path", "class", points.alias("ring"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _colour(value: str | None) -> str:
    v = (value or "").strip().upper()
    return v if not v or v.startswith("#") else f"#{v}"


def _ring(points: list[tuple[str | None, str | None]], scale: float) -> list[dict] | None:
    ring = [{"x": float(x) * scale, "y": float(y) * scale} for x, y in points if x is not None and y is not None]
    return ring if len(ring) >= 3 else None


def _parsed(docs: DataFrame, rows_of) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(p, c, r) for p, content in zip(f["path"], f["content"], strict=True) for c, r in rows_of(ET.fromstring(content)) if r]
            yield pd.DataFrame(out, columns=["path", "class", "ring"])

    return docs.mapInPandas(run, f"path string, class string, ring {RING}")


def xml_regions(spark: SparkSession, path: str, colours: dict[str, str]) -> DataFrame:
    """Regions of annotations by LineColor (as written): class and ring of three points at least."""

    def rows(root: ET.Element):
        for a in root.iter("Annotation"):
            kind = colours.get(str(a.get("LineColor")))
            for region in a.iter("Region") if kind else ():
                yield kind, _ring([(v.get("X"), v.get("Y")) for v in region.iter("Vertex")], 1.0)

    return _parsed(_documents(spark, path), rows)


def xml_coordinates(spark: SparkSession, path: str, colours: dict[str, str], scale: float) -> DataFrame:
    """Annotations with a Coordinates list by Color (hex, normalised), scaled to the full resolution."""

    def rows(root: ET.Element):
        for a in root.iter("Annotation"):
            kind = colours.get(_colour(a.get("Color")))
            if kind:
                yield kind, _ring([(c.get("X"), c.get("Y")) for c in a.findall("./Coordinates/Coordinate")], scale)

    return _parsed(_documents(spark, path), rows)


def ndpa_regions(spark: SparkSession, path: str, labels: dict[str, str], offset_nm: tuple[int, int] = (0, 0), nm_per_pixel: tuple[float, float] = (250.0, 250.0), size: tuple[int, int] = (0, 0)) -> DataFrame:
    """View states by title, points from nanometres around the centre to pixels; points that do not parse are left out."""

    def number(node: ET.Element | None) -> float | None:
        try:
            return float(node.text)  # type: ignore[union-attr,arg-type]
        except (AttributeError, TypeError, ValueError):
            return None

    def rows(root: ET.Element):
        for view in root.findall("ndpviewstate"):
            kind = labels.get((view.findtext("title") or "").strip())
            points = [(number(p.find("x")), number(p.find("y"))) for p in view.findall("annotation/pointlist/point")] if kind else []
            ring = [{"x": (x - offset_nm[0]) / nm_per_pixel[0] + size[0] / 2, "y": (y - offset_nm[1]) / nm_per_pixel[1] + size[1] / 2} for x, y in points if x is not None and y is not None]
            if len(ring) >= 3:
                yield kind, ring

    return _parsed(_documents(spark, path), rows)


def json_regions(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Rings of each field (a list of rings of pairs) with the field's class."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    out = None
    for field, kind in fields.items():
        rings = F.from_json(F.get_json_object("t", f"$.{field}"), "array<array<array<double>>>")
        points = F.transform("r", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        part = raw.select("path", F.lit(kind).alias("class"), F.explode(rings).alias("r")).where("size(r) >= 3").select("path", "class", points.alias("ring"))
        out = part if out is None else out.unionByName(part)
    return out


#: Which reader goes with which pair of image and annotation suffix; fixed values.
HANDLERS = {(".svs", ".xml"): "xml", (".ndpi", ".ndpa"): "ndpa", (".tif", ".json"): "json", (".svs", ".json"): "json"}


def with_handler(pairs: DataFrame, image: str, annotation: str) -> DataFrame:
    """pairs with the handler for their suffixes; NULL if there is none."""
    table = F.create_map(*(F.lit(x) for (i, a), h in HANDLERS.items() for x in (i + a, h)))
    return pairs.withColumn("handler", table[F.concat(suffix_of(F.col(image)), suffix_of(F.col(annotation)))])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("value"))
    return text.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_number", "line"))


def lines_starting(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """path, line_number, line of the lines that start with the prefix."""
    return _lines(spark, path).where(F.col("line").startswith(prefix)).withColumn("line", F.trim("line"))


def lines_after(spark: SparkSession, path: str, markers: dict[str, str]) -> DataFrame:
    """path, line_number, name, line: for each marker line its name and the next line that is not empty."""
    lines = _lines(spark, path).withColumn("line", F.trim("line")).where("line <> ''")
    names = F.create_map(*(F.lit(x) for pair in markers.items() for x in pair))
    after = F.lead("line").over(Window.partitionBy("path").orderBy("line_number"))
    return lines.withColumn("name", F.try_element_at(names, F.col("line"))).withColumn("line", after).where("name is not null and line is not null").select("path", "line_number", "name", "line")


def lines_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """path, line_number, line of the non-empty lines between two marker lines of each file."""
    lines = _lines(spark, path)
    marks = lines.groupBy("path").agg(F.min(F.when(F.trim("line") == start, F.col("line_number"))).alias("a"), F.min(F.when(F.trim("line") == end, F.col("line_number"))).alias("b"))
    return lines.join(marks, "path").where("line_number > a and line_number < b and trim(line) <> ''").select("path", "line_number", F.trim("line").alias("line"))


def model_candidates(spark: SparkSession, path: str, metric: str, architectures: Sequence[str] | None = None) -> DataFrame:
    """Model records (*_meta.json) with a usable metric and of the wanted architectures."""
    t = spark.read.option("multiLine", "true").option("pathGlobFilter", "*_meta.json").schema(f"architecture string, encoder string, checkpoint_path string, compatibility_signature string, {metric} double").json(path)
    t = t.withColumn("architecture", F.upper("architecture")).where(F.col(metric).isNotNull() & ~F.isnan(metric)).where("architecture <> '' and trim(encoder) <> '' and trim(checkpoint_path) <> ''")
    return t.where(F.col("architecture").isin(*[a.upper() for a in architectures])) if architectures is not None else t


def review_labels(approved: DataFrame, rejected: DataFrame) -> DataFrame:
    """stem, label from two file listings; a stem in both is rejected."""
    both = approved.select("stem", F.lit(0).alias("_r")).unionByName(rejected.select("stem", F.lit(1).alias("_r")))
    return both.groupBy("stem").agg(F.when(F.max("_r") == 1, "Rejected").otherwise("Approved").alias("label"))

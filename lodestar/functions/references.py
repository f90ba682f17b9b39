"""Portable path and array references, file names and contracts on them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed formats
LOGICAL = r"^HDF5::([^\[\]]+)\[(\d+)\]$"
RUNTIME = r"^(.+)::([^\[\]]+)\[(\d+)\]$"
PATIENT = r"PATIENT_(\d+)_"
GROUP = r"PATIENT_([^_]+)"


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def patient_of(filename: Column) -> Column:
    """The patient id in a file name; NULL without one."""
    return _found(filename, PATIENT, 1).cast("long")


def group_of(stem: Column) -> Column:
    """The group id in a stem without hyphens and underscores around it; else the whole stem."""
    return F.coalesce(F.nullif(F.regexp_replace(_found(stem, GROUP, 1), r"^[-_]+|[-_]+$", ""), F.lit("")), stem)


def dataset_of(ref: Column) -> Column:
    return F.coalesce(_found(ref, LOGICAL, 1), _found(ref, RUNTIME, 2))


def row_of(ref: Column) -> Column:
    return F.coalesce(_found(ref, LOGICAL, 2), _found(ref, RUNTIME, 3)).cast("long")


def path_of(ref: Column) -> Column:
    """The file of an expanded reference; NULL for a logical one."""
    return F.when(ref.rlike(LOGICAL), F.lit(None)).otherwise(_found(ref, RUNTIME, 1))


def payload_of(rooted: Column) -> Column:
    """The relative path of SOURCE:: and MANIFEST:: references."""
    return _found(rooted, r"^(?:SOURCE|MANIFEST)::(.+)$", 1)


def is_portable(rooted: Column) -> Column:
    """Whether a rooted reference is one: known root, forward slashes, relative, no drive, no part that goes up; empty and single-dot parts say nothing, as in any path."""
    p = F.coalesce(payload_of(rooted), F.lit(""))
    bad = (p == "") | p.contains("\\") | p.startswith("/") | p.rlike(r"^[A-Za-z]:") | F.exists(F.split(p, "/"), lambda x: x == "..")
    return ~bad


def rooted(path: Column, root: str, prefix: str) -> Column:
    """A path under root as a reference; NULL if it is not under it."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.concat(F.lit(prefix), F.substring(path, len(root) + 1, 1_000_000)))


def expand(logical: Column, shard: Column, base: str) -> Column:
    """A logical array reference as a path: base, the shard's payload, dataset and row."""
    return F.concat(F.lit(base.rstrip("/") + "/"), payload_of(shard), F.lit("::"), dataset_of(logical), F.lit("["), row_of(logical).cast("string"), F.lit("]"))


def pair_is_valid(image: Column, mask: Column) -> Column:
    """Both empty, or an image and a mask reference to the same row of the same file."""
    image, mask = F.coalesce(image, F.lit("")), F.coalesce(mask, F.lit(""))
    both = (dataset_of(image) == "images") & (dataset_of(mask) == "masks") & (row_of(image) == row_of(mask)) & path_of(image).eqNullSafe(path_of(mask))
    return ((image == "") & (mask == "")) | F.coalesce(both, F.lit(False))


def sanitised(value: Column, fill: str = "-", default: str = "unknown") -> Column:
    """Other characters than letters, digits, dot, underscore and hyphen become fill; none of . _ - around; default if nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(value.cast("string")), "[^A-Za-z0-9._-]+", fill), "^[-._]+|[-._]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def patch_filename(label: Column, patient: Column, slide: Column, x: Column, y: Column) -> Column:
    return F.concat(sanitised(label), F.lit("_PATIENT_"), sanitised(patient), F.lit("_SLIDE_"), sanitised(slide), F.lit("_X_"), x.cast("long").cast("string"), F.lit("_Y_"), y.cast("long").cast("string"), F.lit(".png"))


def portable_candidates(source: Column) -> Column:
    """Keys under which a stored path may be known, most exact first: the reference, its payload, from an anchor folder on, the base name."""
    is_ref = source.rlike(r"^(?:MANIFEST|SOURCE)::")
    text = F.when(is_ref, F.regexp_replace(source, r"^(?:MANIFEST|SOURCE)::", "")).otherwise(source)
    parts = F.filter(F.split(F.regexp_replace(text, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    anchored = [F.when(F.array_position(parts, a) > 0, F.array_join(F.slice(parts, F.array_position(parts, a).cast("int"), F.size(parts)), "/")) for a in ("PATCHES", "HDF5_SHARDS")]
    return F.array_distinct(F.array_compact(F.array(F.when(is_ref, source), F.when(is_ref, text), *anchored, F.when(F.size(parts) > 0, F.element_at(parts, -1)))))


def hex_colour(value: Column) -> Column:
    """#RRGGBB in upper case, with the mark added where it is missing."""
    v = F.upper(F.trim(value))
    return F.when(v.startswith("#"), v).otherwise(F.concat(F.lit("#"), v))

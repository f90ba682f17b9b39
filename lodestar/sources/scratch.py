"""Folders and small files that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from lodestar import ship


def filesystem(spark: SparkSession, path: str):
    """The file system of path, and path in its terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed when the session ends. Only a local session may name none."""
    ship(spark)
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = tempfile.mkdtemp(prefix="lodestar-")
    path = f"{base}/lodestar-files-{uuid.uuid4().hex}"
    files, at = filesystem(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def put(spark: SparkSession, path: str, content: str | bytes) -> None:
    """One small file with the content; folders above it are made."""
    files, at = filesystem(spark, path)
    out = files.create(at, True)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()


def local(path: str) -> str:
    """The path for libraries that open files themselves; fails for other stores."""
    plain = re.sub(r"^file:(//)?", "", path)
    if re.match(r"[a-z][a-z0-9+.-]*:", plain):
        raise ValueError(f"not a path of a mounted folder: {path}")
    return plain

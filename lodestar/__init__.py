"""Lineage, evaluation and training-data analytics as PySpark DataFrame operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Rows go to Python workers in batches of at most so many bytes (a single row may be longer), whatever a table's texts are like.
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, so that their Python workers can import it, and bounds Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestar-"), "lodestar.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.join("lodestar", os.path.relpath(at, root)))
    sc.addPyFile(path)  # the driver serves it; nothing is read from a local folder of another machine
    _SHIPPED.add(sc.applicationId)

"""Prepares a session: the package is importable by its Python workers, and Arrow batches are of moderate size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once for each Spark application."""
    # Whole texts make batches of Spark's own default sizes large; what a user has set stays.
    if BATCH_ROWS not in spark.conf.getAll:
        spark.conf.set(BATCH_ROWS, "2000")
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, "8388608")
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="tessera-py-")) / "tessera.zip"
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, os.path.relpath(path, root.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark

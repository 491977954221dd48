"""Brings the package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of a batch of rows that a worker gets at once, where the session leaves it at Spark's default; long texts make rows large.
BATCH_BYTES, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Once per application: adds the package to the Python path of the session's workers; and bounds their batches."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    if getattr(context, "_folioquery", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # the driver serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, "folioquery.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    context._folioquery = True

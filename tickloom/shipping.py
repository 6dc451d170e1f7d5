"""Sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows of an Arrow batch: of whole texts, the usual 10,000 are too many for a worker's memory.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once per application, and keeps the
    batches that they get small."""
    sc, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if getattr(sc, "_tickloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    name = os.path.join(tempfile.mkdtemp(), f"{top.name}_code.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(name)
    sc._tickloom_shipped = True

"""Makes this package importable in Python workers of executors that do not have it installed."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows that go to a Python worker at once, where the session sets no number: whole texts are long, and Spark's 10,000
#: rows are held several times over, by the executor and by the worker.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application, and bound the batches for Python workers."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="tidemark-ship-")
    path = os.path.join(folder, "tidemark_sources.zip")
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(os.path.realpath(path))
    _SHIPPED.add(sc.applicationId)

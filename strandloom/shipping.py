"""What the package's Python tasks need of a session: its own code on the executors, and batches of bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch that a Python task is sent; both sides hold a few at a time.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once for each application.

    Batches are bounded by BATCH_BYTES unless the session sets a bound itself, since texts differ in length and a bound by
    rows lets a batch grow with them.
    """
    if _BATCHES not in spark.conf.getAll:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    handle, path = tempfile.mkstemp(prefix="strandloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)

"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bounds of the batches that go to Python workers, where the session has set none:
#: rows, and bytes, so that a run of long texts is no large batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8m")}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, so that
    Python workers can import it on any cluster; bound the batches they get."""
    context = spark.sparkContext
    for key, (default, bound) in BATCHES.items():
        if spark.conf.get(key, default) in (default, f"{default}b"):
            spark.conf.set(key, bound)
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
            for path in sorted(root.rglob("*.py")):
                target.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark

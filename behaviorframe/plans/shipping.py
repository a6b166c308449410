"""Python workers of a local session get this package wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Local sessions only: on a cluster the package is deployed with --py-files or PYTHONPATH."""
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster") or context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="package-")) / "package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)

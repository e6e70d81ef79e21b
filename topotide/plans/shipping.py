"""Making this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    name = Path(tempfile.mkdtemp(prefix="spark-")) / "topotide.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "topotide").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(name))
    _shipped.add(context.applicationId)

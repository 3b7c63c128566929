"""The package, sent to the workers, so that queries run from any folder and on any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send this package to the session's workers, once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_flowmill_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="flowmill-")) / "flowmill.zip"  # Spark copies it from here to the workers
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, Path(PACKAGE.name) / f.relative_to(PACKAGE))
    context.addPyFile(str(path))
    context._flowmill_shipped = True

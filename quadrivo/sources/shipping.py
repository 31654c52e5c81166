"""This package at the Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context, so that they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quadrivo_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="quadrivo-")) / f"{top.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(to))
    context._quadrivo_shipped = True

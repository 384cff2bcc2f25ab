"""What a session needs before Python functions of this package run in it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's modules to the executors, once for each application, so that their workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
    context._lodestone_shipped = True
    return spark

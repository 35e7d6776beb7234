"""Giving this package to the Python of executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to all executors, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as to:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    to.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
    context.addPyFile(path)
    context._tessera_shipped = True

"""The package on the executors, whose Python workers may have it on no path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the workers of this application, once."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _shipped or not os.path.isdir(root):
        return
    _shipped.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="quillgraph-"), "quillgraph.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quillgraph", os.path.relpath(full, root)))
    sc.addPyFile(path)

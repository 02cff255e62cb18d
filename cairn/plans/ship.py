"""Making this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import cairn

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application. Workers that can import it otherwise aren't affected."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    root = os.path.dirname(os.path.abspath(cairn.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="cairn-"), "cairn_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _done.add(app)

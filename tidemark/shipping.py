"""Send this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the Spark context, once for each application."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId in _shipped:
            return
        top = os.path.dirname(os.path.abspath(__file__))
        at = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
        with zipfile.ZipFile(at, "w") as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        path = os.path.join(folder, n)
                        z.write(path, os.path.relpath(path, os.path.dirname(top)))
        sc.addPyFile(at)
        _shipped.add(sc.applicationId)

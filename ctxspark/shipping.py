"""Makes the package importable in Python workers that do not see its folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once; nothing to do where PYTHONPATH or
    the working folder has it already."""
    sc = spark.sparkContext
    seen = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in seen or os.path.abspath(os.getcwd()) == ROOT or sc.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ctxspark-"), "ctxspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "ctxspark")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)

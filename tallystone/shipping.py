"""Gets this package to the Python workers of a session that was not started with it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's files, once per application; nothing to do where workers inherit it by PYTHONPATH."""
    sc = spark.sparkContext
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT.parent) in paths or sc.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tallystone-"), "tallystone.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)

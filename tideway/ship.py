"""Makes this package importable on executors that do not have the repository on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def package(spark: SparkSession) -> None:
    """Sends the package as a zip file, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tideway-ship-")
    tree = Path(folder, "tree", here.name)
    shutil.copytree(here, tree, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, f"{here.name}-package"), "zip", tree.parent))

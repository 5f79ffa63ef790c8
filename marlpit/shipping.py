"""Getting this package to the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once in an application, so that functions run in tasks can be imported there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='marlpit-')}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)

"""Ship this package to the executors of a session that can't import it by themselves."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers a zip of the package, once per application (as --py-files does)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        made = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="package-")) / root.name), "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(made)
        _SHIPPED.add(app)

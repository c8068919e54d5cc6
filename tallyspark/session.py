"""What a session needs before the library's Python functions can run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors of ``spark`` once, so that functions pickled by reference can be imported there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="tally-"), f"{top.name}.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for source in sorted(top.rglob("*.py")):
                archive.write(source, str(source.relative_to(top.parent)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark

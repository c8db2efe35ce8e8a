"""The package itself for the executors' Python workers, which need not see the driver's folders."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    package = Path(__file__).resolve().parent.parent
    name = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(name))
    _SENT.add(app)

"""Python code of this package for the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per application, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # else it was imported from an archive that Spark itself distributes
        out = Path(tempfile.mkdtemp(prefix="edgeloom-code-")) / "edgeloom.zip"
        with zipfile.ZipFile(out, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, f"{root.name}/{path.relative_to(root)}")
        sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)

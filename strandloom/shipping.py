"""Making this package importable by the Python workers of every executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package with the application, once; the driver serves the file, no folder is shared for it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    bundle = Path(tempfile.mkdtemp(prefix=f"{_PACKAGE.name}-")) / f"{_PACKAGE.name}_bundle.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(bundle))
    _shipped.add(sc.applicationId)

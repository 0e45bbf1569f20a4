"""The package for Python workers that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once an application; Spark itself carries the file from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    target = Path(tempfile.mkdtemp(prefix="kairosight-code-")) / "kairosight_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent).as_posix())
    sc.addPyFile(str(target))
    _sent.add(sc.applicationId)

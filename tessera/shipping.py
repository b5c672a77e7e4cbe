"""Sending this package to the Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make the package importable on every worker, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(Path("tessera") / p.relative_to(PACKAGE)))
    sc.addPyFile(str(target))
    sc._tessera_shipped = True

"""Session settings that suit wide harmonization projections."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Generated methods above 8000 bytes are never compiled by the JVM.  Above this size
#: Spark then evaluates the projection in many small methods instead, which is several
#: times faster for tables with many text columns.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session; all of them may change while it runs."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return importable(spark)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from a checkout (installed packages need nothing)."""
    folder, paths = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = [p for p in paths.get("PYTHONPATH", "").split(os.pathsep) if p]
    if folder not in known:
        paths["PYTHONPATH"] = os.pathsep.join([folder, *known])
    return spark

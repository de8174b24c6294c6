"""Sessions, and getting this package to executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lumenframe")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, unless they inherit its place.

    Python workers find it by themselves if its parent folder is on
    PYTHONPATH or is the working directory.
    """
    parent = str(PACKAGE.parent)
    application = spark.sparkContext.applicationId
    found = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.path.realpath(os.getcwd())}
    if parent in found or application in _SHIPPED:
        return spark
    _SHIPPED.add(application)
    name = os.path.join(tempfile.mkdtemp(prefix="lumenframe-"), "lumenframe.zip")
    with zipfile.ZipFile(name, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(name)
    return spark

"""Sessions, and the way to executors for this package's own code."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "lodestone", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(app).master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once an application; they need no path of their own to it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        to = os.path.join(tempfile.mkdtemp(prefix="lodestone-code-"), "lodestone_code.zip")
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, str(p.relative_to(here.parent)))
        spark.sparkContext.addPyFile(to)
        _shipped.add(app)
    return spark

"""Session defaults and the shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "kinetrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_kinetrail_shipped", None) != context.applicationId:
        top = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="kinetrail-"), "kinetrail.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(top.rglob("*.py")):
                out.write(path, str(path.relative_to(top.parent)))
        context.addPyFile(archive)
        context._kinetrail_shipped = context.applicationId
    return spark

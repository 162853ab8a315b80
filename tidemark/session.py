"""Session helpers: every query runs on the session it is given; these only build one for tests, bench and CLI."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "tidemark", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with adaptive execution on; for a cluster, pass your own session instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: once per application, and only where no PYTHONPATH of theirs leads to it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _SHIPPED or root in known or root.endswith(".zip"):
        return
    folder = tempfile.mkdtemp(prefix="tidemark-package-")
    archive = shutil.make_archive(os.path.join(folder, "tidemark"), "zip", root, "tidemark")
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)

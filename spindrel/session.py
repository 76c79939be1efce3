"""Sessions, and the package on the workers of a session."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable for the session's Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        here = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp(prefix="spindrel-package-"))
        shutil.copytree(here, folder / "in" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(folder / "spindrel_package"), "zip", folder / "in"))
    return spark


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "8g", name: str = "spindrel") -> SparkSession:
    """A session of one machine, for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or cores)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

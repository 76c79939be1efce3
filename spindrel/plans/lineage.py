"""Lineage cuts that survive the loss of executors.

Intermediate tables are written as Parquet below the folder the cluster names in
``spark.checkpoint.dir``. Every executor can read them again, so a lost executor
costs a re-read and no recomputation of the steps before the cut.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one in local mode only, where the setting may be unset."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{SETTING} must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spindrel-")
    spark.conf.set(SETTING, folder)
    return folder


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this application. Results built on them can't be read afterwards."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        place = hadoop.Path(path)
        place.getFileSystem(conf).delete(place, True)


def scratch(spark: SparkSession, label: str = "scratch") -> str:
    """A folder of its own below the shared one, deleted with the tables."""
    path = f"{shared_dir(spark)}/spindrel/{label}-{uuid.uuid4().hex}"
    _note(spark, path)
    return path


def _note(spark: SparkSession, path: str) -> None:
    if spark.sparkContext.applicationId not in _written:
        _written[spark.sparkContext.applicationId] = []
        atexit.register(_clean, spark)
    _written[spark.sparkContext.applicationId].append(path)


def _clean(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the JVM may be gone by now
        pass

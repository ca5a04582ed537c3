"""Session settings and the shared folder for checkpoints and stream output."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed partition is split even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options the jobs rely on; sizing stays with the cluster."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "8", partitions: str = "8") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    return tune(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("contrail")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="contrail-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without the setting; it then gets a new folder
    on this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses; :func:`forget_scratch` clears it."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def forget_scratch(spark: SparkSession) -> int:
    """Delete what this driver has written under scratch paths, with stream checkpoints beside them.

    To be called once the results that were built on them have been written or read.
    """
    files = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    gone = 0
    while _scratch:
        path = _scratch.pop()
        for name in (path, f"{path}-checkpoint"):
            place = files.Path(name)
            gone += bool(place.getFileSystem(conf).delete(place, True))
    return gone


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: several passes then read it, a lost executor too."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

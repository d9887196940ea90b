"""Spark session and checkpoint-folder helpers.

Library code never creates its own session; it receives one.  ``get_session`` is a
convenience for tests, the bench and notebooks.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job here relies on: AQE re-plans joins/partition counts at runtime,
# skew-join splitting handles a hot key, UTC keeps date casts engine-independent.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "tarmac",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf["spark.driver.memory"] = "8g"   # local mode: the driver JVM is the executor
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and hand-over tables.

    Taken from the session (``spark.checkpoint.dir`` or an already set checkpoint dir).
    Only when neither is set - local tests - a fresh folder under the temp dir is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            # A machine-local folder is not shared by executors: refuse on a cluster.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3) "
                               "for checkpoints and hand-over tables")
        conf_dir = tempfile.mkdtemp(prefix="tarmac-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the checkpoint folder, namespaced by application id."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", spark.sparkContext.applicationId, *parts)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (``addPyFile``), once per application.

    Functions that run in Python workers name this package's modules; on a cluster the
    workers would not find them otherwise.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(package)}_py.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder or file by Spark's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

"""The folder that the driver and all executors share, and the state of a table's files."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode, where it is unset, a folder that goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = f"file://{folder}"
    return _LOCAL[app]


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything under a path?"""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def file_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(files, bytes, latest change) under a path, by the file system that holds it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, n, size, latest = system.listFiles(place, True), 0, 0, 0
    while found.hasNext():
        status = found.next()
        n, size, latest = n + 1, size + status.getLen(), max(latest, status.getModificationTime())
    return n, size, latest

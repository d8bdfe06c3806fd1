"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of its own only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = f"file://{folder}"
    return _LOCAL[app]


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole texts: fewer rows than Spark's default, unless the session set its own number."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, rows)


ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of large binary rows: bounded in bytes, which the JVM holds outside its heap, where the session has Spark's default."""
    if spark.conf.get(ARROW_BYTES) == "67108864b":
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)


def local_table(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A few rows of the driver's, handed over as Arrow: lists of rows would pass through Python workers on the executors."""
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds)))


def quoted(name: str) -> str:
    """A column's name as one identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


class Scratch:
    """Intermediate tables of one run. Lost executors only recompute from the last written table.

    ``packed`` tables hold large values that are compressed already: they are not compressed again, for which the
    JVM would hold whole pages outside its heap.
    """

    def __init__(self, spark: SparkSession, label: str, packed: bool = False):
        bounded_batches(spark)
        if packed:
            small_batches(spark)
        self.codec = {"compression": "uncompressed"} if packed else {}
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: list[str] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.parquet(path, **self.codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.paths.append(path)
        return out

    def sweep(self, *kept: DataFrame) -> None:
        """Delete all saved tables of this run but ``kept``, which alone are read from now on."""
        left = {df.scratch_path for df in kept}
        for path in [x for x in self.paths if x not in left]:
            self._delete(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        self._delete(df.scratch_path)

    def _delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.paths.remove(path)

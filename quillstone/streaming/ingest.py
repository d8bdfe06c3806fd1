"""Incremental ingest: new documents become chunks once, in batch or from a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.operators.chunking import chunk_windows, line_atoms
from quillstone.sources.shared import exists


def pending(inputs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Inputs that have no result yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def changed(inputs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Inputs whose text differs from that of the result (key, fingerprint), or that have none."""
    own = inputs.withColumn("fingerprint", F.substring(F.sha1("text"), 1, 16))
    return own.join(done.select(key, "fingerprint"), [key, "fingerprint"], "left_anti")


def chunk_batch(docs: DataFrame, target: int, overlap: int) -> DataFrame:
    return chunk_windows(line_atoms(docs).select("doc", "pos", "cost"), target, overlap)


def stream_chunks(
    spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, target: int, overlap: int, files_per_batch: int = 1
) -> None:
    """Chunk every Parquet file that appears under ``source`` into ``out``, as far as there are any, and stop.

    Each micro-batch drops documents that earlier batches have written chunks of, and of several texts under
    one id in a batch takes the least. It writes a folder of its own, so a batch that is run again after a failure replaces what it wrote.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def upsert(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        fresh = batch.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
        if exists(own, out):
            done = own.read.parquet(out).where(F.col("batch") < number)
            fresh = pending(fresh, done.withColumnRenamed("doc", "doc_id"))
        chunk_batch(fresh, target, overlap).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()

"""File sources and sinks: chunk lines, manifests, binary reports, partitioned chunk tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions import constants as C

CHUNK_SCHEMA = (
    "chunk_id string, code string, name string, period string, section string, page_start int, page_end int, "
    "chunk_index int, tokens int, chars int, has_table boolean, has_multicol boolean, text string"
)
REPORT_SCHEMA = (
    "generated_at string, report_period string, source string, count int, reports array<struct<code:string,name:string,"
    "title:string,announce_date:string,url:string,filename:string,size_bytes:bigint,pages:int,downloaded_at:string>>"
)


def read_chunks(spark: SparkSession, path: str, limit: int | None = None, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """JSON lines, blank ones skipped; a limit takes the first by chunk_id."""
    rows = spark.read.schema(schema).json(path).where("chunk_id is not null")
    return rows if limit is None else rows.orderBy("chunk_id").limit(limit)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per report of a manifest file."""
    whole = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)
    return whole.select("report_period", F.explode("reports").alias("r")).select("report_period", "r.*")


def read_reports(spark: SparkSession, path: str, least: int = C.MIN_FILE_BYTES) -> DataFrame:
    """Files with their content; those too small to be a report are left out."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") >= least)


def page_counts(reports: DataFrame) -> DataFrame:
    """(path, pages) of PDF files; null where no reader is installed or a file cannot be read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from io import BytesIO

            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for part in parts:
            pages = []
            for content in part["content"]:
                try:
                    reader = PdfReader(BytesIO(content)) if PdfReader else None
                    if reader is not None and reader.is_encrypted:
                        reader.decrypt("")
                    pages.append(len(reader.pages) if reader is not None else None)
                except Exception:  # noqa: BLE001 - an unreadable file has no page count
                    pages.append(None)
            yield pd.DataFrame({"path": part["path"], "pages": pd.array(pages, "Int32")})

    return reports.select("path", "content").mapInPandas(run, "path string, pages int")


def write_by_code(chunks: DataFrame, path: str) -> None:
    """One partition per code; only the codes that are written are replaced."""
    chunks.write.partitionBy("code").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_by_code(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)

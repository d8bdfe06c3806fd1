"""From documents to packed training sequences, stage after stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import language, packing
from quillstone.llm.decontaminate import contamination
from quillstone.llm.line_dedup import deduplicate_lines
from quillstone.llm.near_dedup import near_duplicates
from quillstone.llm.scratch import Scratch, quoted
from quillstone.llm.stars import pick
from quillstone.sources import table


#: Share of a text's n-grams that its language must contain at least.
LEAST_SCORE = 0.2


def _columns(docs: DataFrame) -> list[str]:
    """The columns' names as identifiers, whatever characters they have."""
    return [quoted(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language go: those that are null or have no letter, and those with few n-grams of any learnt language."""
    rows = docs.select(F.struct("*").alias("row"))
    found = rows.select("row", language.predicted(F.col("row").getField("text"), language.train(docs)).alias("found"))
    return found.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_SCORE)).select("row.*")


def deduplicate_document_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzy repeated lines go, and documents of which nothing is left."""
    kept = deduplicate_lines(docs).where("n_kept > 0 and (n_kept = n_lines or trim(both ' \t\r\n' from text) != '')")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    found = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    copies = Scratch(spark, "copies").save(found, "copies")
    return pick(docs, copies, copies.count(), "left_anti", "doc_id").select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=None)
    return found.where("not contaminated").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_document_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Tokenisation and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs

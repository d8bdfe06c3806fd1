"""Extraction reports: totals, histograms, suspicious pages, medians, fingerprints, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as C


def suspicious_reason(chars: Column, error: Column, low: int = C.LOW_TEXT) -> Column:
    """Why a page is listed: its error, no text, too little text; null for a sound page."""
    few = F.concat(F.lit("low text: "), chars.cast("string"), F.lit(f" < {low}"))
    return F.when(error.isNotNull(), error).when(chars == 0, "no text").when(chars < low, few)


def upper_median(value: str) -> Column:
    """The middle element, the higher of two. The group's values meet in one row: for counts of bounded size."""
    ordered = F.array_sort(F.collect_list(value))
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def upper_median_of(values: DataFrame, value: str) -> DataFrame:
    """The upper median of a column of any size, from a histogram of its values."""
    counts = values.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    marked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
    return marked.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("v").alias("median"))


def fingerprint(rows: DataFrame, model: str, by: str = "grp", pos: str = "pos", text: str = "text") -> DataFrame:
    """(grp, fingerprint): the first 16 digits of SHA-1 over a model name and all texts in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text])
    return rows.groupBy(by).agg(F.substring(F.sha1(F.concat(F.lit(model), F.array_join(ordered, ""))), 1, 16).alias("fingerprint"))


def stratified_sample(rows: DataFrame, key: str, strata: list[Column], n: int, seed: int = C.SAMPLE_SEED) -> DataFrame:
    """``n`` rows: one of each stratum first, the rest uniform; the same seed draws the same rows.

    Adds ``pick``, the order. A stratum's pick is its row with the smallest draw that no earlier
    stratum took.
    """
    drawn = rows.withColumn("draw", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    rank = F.lit(len(strata))
    taken = drawn.withColumn("level", rank)
    for level, stratum in enumerate(strata):
        free = (F.col("level") == len(strata)) & F.coalesce(stratum, F.lit(False))
        best = taken.where(free).agg(F.min("draw").alias("best"))
        taken = taken.join(F.broadcast(best)).withColumn(
            "level", F.when(F.coalesce(free & (F.col("draw") == F.col("best")), F.lit(False)), level).otherwise(F.col("level"))
        ).drop("best")
    picked = taken.orderBy("level", "draw").limit(n)
    order = Window.orderBy("level", "draw")
    return picked.withColumn("pick", F.row_number().over(order)).drop("draw", "level")


def reconcile(counts: DataFrame, manifest: DataFrame, key: str = "code") -> DataFrame:
    """(code, pages, manifest_pages, ok): counted pages against the manifest's."""
    joined = counts.join(manifest, key, "left")
    return joined.select(key, "pages", "manifest_pages", F.coalesce(F.col("pages") == F.col("manifest_pages"), F.lit(False)).alias("ok"))


def report_markdown(overview: DataFrame) -> str:
    """A table of an overview's rows (one per report) for people to read."""
    names = overview.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in overview.orderBy(names[0]).toLocalIterator()]
    return "\n".join(lines) + "\n"

"""Report acquisition: identifiers, announcement filters, picks and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as C


def resolve_ids(codes: DataFrame, found: DataFrame, fallback: DataFrame, category: str = "A股") -> DataFrame:
    """(code, org_id): the service's answer (code, category, org_id), else the fixed one; an error where neither knows it."""
    live = found.where(F.col("category") == category).groupBy("code").agg(F.min("org_id").alias("live"))
    joined = codes.join(live, "code", "left").join(fallback.select("code", F.col("org_id").alias("fixed")), "code", "left")
    unknown = F.raise_error(F.concat(F.lit("no organisation id for "), F.col("code"))).cast("string")
    return joined.select("code", F.coalesce("live", "fixed", unknown).alias("org_id"))


def title_reason(
    title: Column, required: list[str] = C.TITLE_REQUIRED, excluded: list[str] = C.TITLE_EXCLUDED, year: str = C.TITLE_YEAR,
    default: str = C.TITLE_DEFAULT_REASON,
) -> Column:
    """Null for the title of a full report, else the first excluded word in it or the default reason."""
    bad = F.try_element_at(F.filter(F.array(*map(F.lit, excluded)), lambda w: F.contains(title, w)), F.lit(1))
    needed = F.exists(F.array(*map(F.lit, required)), lambda w: F.contains(title, w)) & F.contains(title, F.lit(year))
    return F.when(needed & bad.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(bad, F.lit(default)))


def pick_latest_largest(records: DataFrame, by: str, date: str, size: str, ordinal: str) -> DataFrame:
    """One record of each group: the latest, then the largest, then the first."""
    order = Window.partitionBy(by).orderBy(F.desc(date), F.desc(size), ordinal)
    return records.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def upsert_manifest(old: DataFrame, new: DataFrame, catalog: DataFrame, key: str = "code") -> DataFrame:
    """``new`` replaces ``old`` by key; ``place`` orders by the catalog (key, ord), unknown keys last."""
    merged = old.join(new, key, "left_anti").unionByName(new).join(catalog, key, "left")
    order = Window.orderBy(F.asc_nulls_last("ord"), key)
    return merged.withColumn("place", F.row_number().over(order)).drop("ord")


def select_codes(catalog: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog rows of the asked codes, and asked codes that the catalog lacks."""
    return catalog.join(asked, "code", "left_semi"), asked.join(catalog, "code", "left_anti")

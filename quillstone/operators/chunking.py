"""Overlapping chunks of atoms under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as C


def chunk_windows(atoms: DataFrame, target: int = C.CHUNK_TOKENS, overlap: int = C.OVERLAP_TOKENS) -> DataFrame:
    """(doc, chunk, first, past): windows over atoms (doc, pos, cost), pos from 0 and cost at least 1.

    A window ends with the atom that makes it reach ``target``; the next begins so that the atoms it
    repeats cost ``overlap`` at most, and after the first atom in any case. Ends and overlaps of every
    boundary come from range frames over running costs; only the walk from window to window is
    sequential, over one small array of a document.
    """
    by = Window.partitionBy("doc")
    total = by.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = atoms.select("doc", "pos", F.sum("cost").over(total).cast("long").alias("p"))
    # Boundary k lies before atom k: its running cost is that of atoms 0..k-1.
    bounds = sums.select("doc", (F.col("pos") + 1).alias("k"), "p").unionByName(
        atoms.select("doc").distinct().select("doc", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("p")),
    )
    cost = by.orderBy("p")
    ahead = cost.rangeBetween(target, Window.unboundedFollowing)
    behind = cost.rangeBetween(-overlap, Window.currentRow)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = bounds.select(
        "doc", "k",
        F.coalesce(F.min("k").over(ahead), F.max("k").over(whole)).alias("end"),
        F.min("k").over(behind).alias("back"),
        F.max("k").over(whole).alias("n"),
    )
    # next(s) = max(s + 1, back(end(s))), looked up in the document's own arrays.
    packed = steps.groupBy("doc").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "end", "back"))), lambda x: F.struct(x["end"].alias("end"), x["back"].alias("back"))).alias("s"),
        F.first("n").alias("n"),
    )
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<first:bigint,past:bigint>>").alias("out"))

    def walk(acc, k):
        end = F.col("s")[acc["at"].cast("int")]["end"]
        back = F.col("s")[end.cast("int")]["back"]
        moved = F.struct(
            F.when(end >= F.col("n"), F.col("n")).otherwise(F.greatest(acc["at"] + 1, back)).alias("at"),
            F.array_append(acc["out"], F.struct(acc["at"].alias("first"), end.alias("past"))).alias("out"),
        )
        return F.when(k == acc["at"], moved).otherwise(acc)

    walked = packed.where("n > 0").select(
        "doc", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), state, walk, lambda acc: acc["out"]).alias("w")
    )
    return walked.select("doc", F.posexplode("w").alias("chunk", "x")).select(
        "doc", (F.col("chunk") + 1).alias("chunk"), F.col("x.first").alias("first"), F.col("x.past").alias("past")
    )


def chunk_rows(atoms: DataFrame, windows: DataFrame, cost=None) -> DataFrame:
    """One row per chunk of atoms (doc, pos, kind, page, section, text, table_id, header, is_header, multicol).

    The first row of a table in a chunk is preceded by the table's header if it is no header row
    itself. The repeated header is not charged to the budget; ``tokens`` and ``chars`` are
    those of the assembled text.
    """
    inside = windows.join(atoms, "doc").where("pos >= first and pos < past")
    seen = Window.partitionBy("doc", "chunk", "table_id").orderBy("pos")
    lead = (
        (F.col("kind") == "table-row") & (F.row_number().over(seen) == 1) & ~F.coalesce("is_header", F.lit(False))
        & (F.trim(F.coalesce("header", F.lit(""))) != "")
    )
    body = F.when(lead, F.concat(F.lit(C.TABLE_HEADER_MARK), F.col("header"), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    rows = inside.withColumn("body", body).groupBy("doc", "chunk").agg(
        F.min_by("section", "pos").alias("section"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.bool_or(F.col("kind") == "table-row").alias("has_table"),
        F.bool_or(F.coalesce("multicol", F.lit(False))).alias("has_multicol"),
        F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("parts"),
    )
    text = F.array_join(F.filter(F.col("parts.body"), lambda t: F.trim(t) != ""), "\n")
    rows = rows.withColumn("text", text).drop("parts").withColumn("chars", F.length("text"))
    rows = rows.withColumn("tokens", F.col("chars") if cost is None else cost(F.col("text")))
    return rows.withColumn("chunk_id", F.format_string("%s_%04d", F.col("doc").cast("string"), F.col("chunk")))


def line_atoms(docs: DataFrame) -> DataFrame:
    """Lines of documents as atoms: pos counts non-empty lines, lines with bars are table rows, a page is 20 lines."""
    lines = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).where("text != ''")
    order = Window.partitionBy("doc").orderBy("line")
    bars = F.contains("text", F.lit("|"))
    rows = lines.select(
        "doc", (F.row_number().over(order) - 1).cast("long").alias("pos"), "text", F.length("text").alias("cost"),
        F.when(bars, "table-row").otherwise("text").alias("kind"),
    )
    # A table is a run of table rows; its first row is its header.
    by_pos = Window.partitionBy("doc").orderBy("pos")
    before = F.coalesce(F.lag("kind").over(by_pos), F.lit(""))
    rows = rows.withColumn("is_header", (F.col("kind") == "table-row") & (before != "table-row"))
    rows = rows.withColumn("table_id", F.when(F.col("kind") == "table-row", F.sum(F.col("is_header").cast("int")).over(by_pos)))
    top = F.first("text").over(Window.partitionBy("doc", "table_id").orderBy("pos"))
    return rows.select(
        "doc", "pos", "kind", (F.floor(F.col("pos") / 20) + 1).cast("int").alias("page"), F.lit("body").alias("section"), "text", "cost",
        "table_id", F.when(F.col("kind") == "table-row", top).alias("header"), "is_header", F.lit(False).alias("multicol"),
    )

"""Section state over lines and pages, tables of contents, bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.functions.text import canonical_section


def contents_pages(lines: DataFrame, heading: Column, leader: Column | None = None, marks: int = C.TOC_MARKS) -> DataFrame:
    """(doc, page, n_headings, n_leaders, is_toc) of lines (doc, page, line, text)."""
    leader = F.col("text").rlike(C.DOT_LEADER) if leader is None else leader
    counts = lines.groupBy("doc", "page").agg(F.count_if(heading).alias("n_headings"), F.count_if(leader).alias("n_leaders"))
    return counts.withColumn("is_toc", (F.col("n_headings") >= marks) | (F.col("n_leaders") >= marks))


def line_sections(lines: DataFrame, heading: Column, name: Column, unknown: str = C.UNKNOWN_SECTION, alone: str = C.CHAPTER_ALONE) -> DataFrame:
    """Lines with their ``section``: the last heading's, across pages, outside pages of contents.

    ``heading`` tells whether a line is one and ``name`` names the section of the column ``title``:
    the line, followed by the next line of the page where a chapter mark stands alone.
    """
    toc = contents_pages(lines, heading).select("doc", "page", "is_toc")
    page = Window.partitionBy("doc", "page").orderBy("line")
    follows = F.lead("text").over(page)
    title = F.when(F.trim("text").rlike(alone) & follows.isNotNull(), F.concat_ws(" ", F.trim("text"), F.trim(follows))).otherwise(F.trim("text"))
    marked = lines.withColumn("title", title).join(toc, ["doc", "page"])
    marked = marked.withColumn("own", F.when(heading & ~F.col("is_toc"), name))
    upto = Window.partitionBy("doc").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.coalesce(F.last("own", ignorenulls=True).over(upto), F.lit(unknown))
    return marked.withColumn("section", filled).drop("title", "own", "is_toc")


def chapter_title(title: Column) -> Column:
    return canonical_section(F.regexp_replace(title, C.CHAPTER, ""))


def bookmark_pages(pages: DataFrame, bookmarks: DataFrame, unknown: str = C.UNKNOWN_SECTION, max_level: int = 2, drop: str = C.DOCUMENT_TITLE) -> DataFrame:
    """(doc, page, section): each page takes the last bookmark (doc, level, title, page, ord) at or before it.

    Pages and bookmarks are merged in one order and the section carried on: an as-of join with one
    sort and no range join.
    """
    marks = bookmarks.where((F.col("level") <= max_level) & ~F.col("title").rlike(drop)).select(
        "doc", F.greatest("page", F.lit(1)).alias("page"), F.lit(0).alias("side"), "ord", F.col("title").alias("section")
    )
    both = marks.unionByName(pages.select("doc", "page", F.lit(1).alias("side"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("section")))
    upto = Window.partitionBy("doc").orderBy("page", "side", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(upto), F.lit(unknown)))
    return found.where("side = 1").select("doc", "page", "section")


def section_method(line_level: DataFrame, bookmark_level: DataFrame, unknown: str = C.UNKNOWN_SECTION, kinds: int = C.SECTION_KINDS) -> DataFrame:
    """(doc, n_line, n_book, method) from the distinct known sections of both levels."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc").agg(F.count_distinct(F.when(F.col("section") != unknown, F.col("section"))).alias(name))

    both = counted(line_level, "n_line").join(counted(bookmark_level, "n_book"), "doc", "full").fillna(0, ["n_line", "n_book"])
    line, book = F.col("n_line") >= kinds, F.col("n_book") >= kinds
    method = F.when(line & book, "headings+bookmarks").when(line, "headings").when(book, "bookmarks").otherwise("none")
    return both.withColumn("method", method)

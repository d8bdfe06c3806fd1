"""Fuzzy line deduplication in DataFrame operations only.

A line's set holds its character shingles: the ``width`` characters from each of its characters on.
Each shingle is hashed once and falls into one of a few bins; the bins' least values are the
signature (one-permutation MinHash), where an empty bin takes the value of the first occupied one in an order
of its own. The values of a few bins make a band, and bands are bucket keys. Equal lines are one
class; the classes of a bucket are linked by stars, confirmed by exact Jaccard similarity (see ``stars``),
components found by distributed union-find, and the first line of each component is kept.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import components
from quillstone.llm.scratch import Scratch, quoted
from quillstone.llm.stars import confirmed_links, paired, pick

#: Bytes of a character in the fixed-width form in which lines are cut.
WIDE = 4


def _places(wide: Column, width: int) -> Column:
    """Where the shingles of a line begin, as 1-based bytes; a line that is shorter is one shingle."""
    last = F.greatest(F.length(wide) - (WIDE * width - 1), F.lit(1))
    return F.sequence(F.lit(1), last, F.lit(WIDE))


def shingles(line: Column, width: int) -> Column:
    """Hashes of the ``width`` characters at each place of a line, in order; equal shingles repeat."""
    # The outer lambda binds the bytes once; a column read in the inner one would be copied for every place.
    whole = F.transform(
        F.array(F.encode(line, "UTF-32")),
        lambda w: F.transform(_places(w, width), lambda p: F.xxhash64(F.substring(w, p, F.lit(WIDE * width)))),
    )
    return whole[0]


def bin_orders(bins: int) -> list[list[int]]:
    """For each bin the bins that it takes its value from, itself first."""
    out = []
    for k in range(bins):
        others = [x for x in range(bins) if x != k]
        random.Random(1000 + k).shuffle(others)
        out.append([k, *others])
    return out


def bucket_keys(bands: int, rows: int) -> Column:
    """Bands of the bins' least values ``m0``, ``m1``, ..., some of which may be null."""
    full = [F.coalesce(*(F.col(f"m{k}") for k in order)) for order in bin_orders(bands * rows)]
    return F.array(*(F.xxhash64(F.lit(b), *full[b * rows : (b + 1) * rows]) for b in range(bands)))


def least_of_bins(bins: int) -> list[Column]:
    """Aggregates of the shingles ``h`` with their ``bin``."""
    return [F.expr(f"min(h) FILTER (WHERE bin = {k})").alias(f"m{k}") for k in range(bins)]


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that is not blank of (id, version, text), with its place and a hash."""
    return (
        docs.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
        .where("trim(both ' \t\r' from line) != ''")
        .withColumn("k1", F.xxhash64("line"))
    )


def _second(line: str = "line") -> Column:
    """With k1, what names a line."""
    return F.xxhash64(F.lit(1), line)


def line_classes(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(k1, k2, lines, bands) of each class of equal lines."""
    bins = bands * rows
    wide = _lines(docs).select("k1", _second().alias("k2"), F.encode("line", "UTF-32").alias("wide"))
    cut = wide.select("k1", "k2", "wide", F.explode(_places(F.col("wide"), width)).alias("p"))
    hashed = cut.select("k1", "k2", "p", F.xxhash64(F.substring("wide", F.col("p"), F.lit(WIDE * width))).alias("h"))
    hashed = hashed.withColumn("bin", F.col("h").bitwiseAND(F.lit(bins - 1)) if bins & (bins - 1) == 0 else F.pmod("h", F.lit(bins)))
    found = hashed.groupBy("k1", "k2").agg(F.expr("count(1) FILTER (WHERE p = 1)").alias("lines"), *least_of_bins(bins))
    return found.select("k1", "k2", "lines", bucket_keys(bands, rows).alias("bands"))


def duplicate_lines(
    docs: DataFrame, scratch: Scratch, *, width: int, similarity: float, bands: int, rows: int
) -> DataFrame:
    """(k1, k2, component) of each class of equal lines of which some line must go."""
    percent = round(100 * similarity)
    # Stars form around the least id: lines with more copies get smaller ones.
    scarcity = F.lit(63) - F.floor(F.log2("lines"))
    rep = F.call_function("shiftleft", scarcity.cast("long"), F.lit(57)) + F.monotonically_increasing_id()
    classes = scratch.save(line_classes(docs, width, bands, rows).select(rep.alias("rep"), "*"), "line-classes")
    kept: list[DataFrame] = []
    named: list[DataFrame] = []

    def ready(reps: DataFrame) -> DataFrame:
        """(rep, n, own): a line of each class that shares a bucket, and its number of shingles."""
        # From here on only these classes and those of several lines are read; the bands of all are done with.
        near = classes.join(reps.withColumn("near", F.lit(True)), "rep", "left").where("near or lines > 1")
        named.append(scratch.save(near.select("rep", "k1", F.col("k2").alias("second"), "lines", F.coalesce("near", F.lit(False)).alias("near")), "line-keys"))
        scratch.drop(classes)
        keys = named[0].where("near").select("rep", "k1", "second")
        found = pick(_lines(docs).select("k1", "line"), keys, keys.count(), "inner", "k1").where(_second() == F.col("second"))
        found = found.select("rep", "line").dropDuplicates(["rep"])
        n = F.size(F.array_distinct(shingles(F.col("line"), width))).cast("long")
        kept.append(scratch.save(found.select("rep", n.alias("n"), F.col("line").alias("own")), "line-texts"))
        return kept[0]

    def shared(pairs: DataFrame) -> DataFrame:
        both = F.array_intersect(shingles(F.col("x"), width), shingles(F.col("y"), width))
        return paired(pairs, kept[0], percent, scratch).select("a", "b", "na", "nb", F.size(both).cast("long").alias("shared"))

    def sets(reps: DataFrame) -> DataFrame:
        return kept[0].join(reps.select("rep", "comp"), "rep").select("rep", "comp", F.array_distinct(shingles(F.col("own"), width)).alias("own"))

    found = components(confirmed_links(classes, ready, shared, sets, percent, scratch), scratch)
    near = found.select(F.col("node").alias("rep"), "component").unionByName(
        found.select(F.col("component").alias("rep"), "component").distinct()
    )
    members = named[0].join(near, "rep", "left").where("component is not null or lines > 1")
    return members.select("k1", F.col("second").alias("k2"), F.coalesce("component", "rep").alias("component"))


def _without(text: Column, gone: str) -> Column:
    """The lines of a text but for the ascending places in ``gone``, by the stretches between them."""

    def left(parts: Column) -> Column:
        begin = F.concat(F.array(F.lit(-1)), F.col(gone))
        end = F.concat(F.col(gone), F.array(F.size(parts)))
        return F.flatten(F.zip_with(begin, end, lambda b, e: F.slice(parts, b + 2, e - b - 1)))

    return F.transform(F.array(F.split(text, "\n", -1)), left)[0]


def deduplicate_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 12, similarity: float = 0.8,
    bands: int = 8, rows: int = 2,
) -> DataFrame:
    """All columns of ``docs`` with the text without its duplicate lines, n_lines and n_kept.

    Lines are parted by newlines. Two lines are linked if the Jaccard similarity of the sets of
    their ``width``-character shingles, taken at every character of the whole line, is ``similarity`` at
    least (a shorter line is one shingle); equal lines always are. Of each component, the line with the smallest
    (id, line number) is kept, all others go. With 8 bands of two values a pair at 0.8
    is missed by all buckets with a probability of some 5e-4, a closer one less.

    Blank lines stay and are not compared. A null text stays null with 0 lines; an empty one has one, blank, line. Rows
    with a null id keep all their lines. Rows that repeat an id with another text are documents of
    their own, with the same text they keep the same lines, those of either. Ties between equal (id, line number) go by a hash of the text.
    Very long texts and lines are read whole, in one task. An empty table gives an
    empty result. Columns of any names pass through, but for n_lines and n_kept, which are replaced.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    whole = docs.select(F.struct("*").alias("row"))
    text = F.col("row").getField(text_col).cast("string")
    keyed = whole.select("row", F.col("row").getField(id_col).cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    named = keyed.select("id", "version", "text").where("id is not null")
    going = scratch.save(
        duplicate_lines(named, scratch, width=width, similarity=similarity, bands=bands, rows=rows), "going"
    )
    scratch.sweep(going)
    keys = going.select("k1", F.col("k2").alias("second"), "component")
    found = pick(_lines(named), keys, keys.count(), "inner", "k1").where(_second() == F.col("second"))
    found = scratch.save(found.select("id", "version", "no", "component"), "copies")
    stays = found.groupBy("component").agg(F.min(F.struct("id", "no", "version")).alias("stay"))
    stays = scratch.save(stays.select("component", F.col("stay.id").alias("i"), F.col("stay.version").alias("v"), F.col("stay.no").alias("k")), "stays")
    gone = pick(found, stays, stays.count(), "inner", "component").where("id != i or version != v or no != k")
    gone = scratch.save(gone.groupBy("id", "version").agg(F.sort_array(F.collect_set("no")).alias("gone")), "gone")
    scratch.sweep(gone)
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("items")).first()
    out = pick(keyed, gone, size["n"], "left", ["id", "version"], size["items"])
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    # A document that loses all its lines keeps an empty text.
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_without(F.col("text"), "gone"), "\n"))
    row = F.col("row").withField(quoted(text_col), left).dropFields("n_lines", "n_kept")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return out.select(row.alias("row"), n_lines.alias("n_lines"), (n_lines - n_gone).alias("n_kept")).select("row.*", "n_lines", "n_kept")


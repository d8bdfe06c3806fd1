"""Links between classes of equal sets: star-shaped candidates in buckets, confirmed on full sets.

In each bucket every class is paired with the least one (a star), so candidates are bounded by
bucket entries. A star loses the links between members that its center does not reach. Where the
confirmed links leave a bucket's members in several components, these members meet once more. In buckets
of up to ``SMALL`` members, each meets each, and parity sketches tell who cannot be alike: a sketch flips one bit for
each element, so two sets differ in as many elements as their sketches in bits, at least. Members of larger buckets are
joined by the prefix filter: elements are put into one order, the presumably rare ones first, and two sets of the
asked similarity share an element among the first few of both. Both ways are exact, and neither
makes pairs of all members of a large bucket, such as lines of one template.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.components import components
from quillstone.llm.scratch import Scratch

#: Rows are broadcast up to this many bytes, as estimated by ``pick``; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64
#: Counters that elements are folded into to tell rare ones from frequent ones.
CELL_BITS = 18
#: Members of a bucket that are all held against each other.
SMALL = 256
#: 64-bit words of a parity sketch.
ODD = 16
#: Sets whose elements one task orders, and tasks at most; with more sets, tasks hold more.
TASK_SETS, MOST_TASKS = 1000, 20_000
#: Pairs of one center that meet it in one task.
SPREAD = 256


def pick(rows: DataFrame, ids: DataFrame, n: int, how: str = "left_semi", on: str | list[str] = "id", items: int = 0) -> DataFrame:
    """``rows`` joined with the ``n`` rows of ``ids``, which are broadcast only within the bound.

    Rows of ``ids`` are a few numbers each; ``items`` more numbers may stand in their lists.
    """
    small = n * ROW_BYTES + items * 8 <= BROADCAST_BYTES
    return rows.join(F.broadcast(ids) if small else ids, on, how)


def alike(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def paired(pairs: DataFrame, own: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Written pairs (a, b) with the sizes na, nb and the sets x, y of both, from ``own`` (rep, n, own).

    Only pairs whose sizes allow the similarity. Centers with many partners are dealt to several tasks.
    """
    heavy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPREAD)
    heavy = scratch.save(heavy.select("a", F.ceil(F.col("n") / SPREAD).cast("int").alias("parts")), "heavy")
    n = heavy.count()
    salted = pick(pairs, heavy, n, "left", "a").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("salt"))
    left = salted.join(own.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("own").alias("y")), "b")
    right = pick(own.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("own").alias("x")), heavy, n, "left", "a")
    right = right.select("a", "na", "x", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    met = left.join(right, ["a", "salt"])
    return met.where(alike("na", "nb", percent)).select("a", "b", "na", "nb", "x", "y")


def confirmed_links(
    classes: DataFrame, ready: Callable[[DataFrame], DataFrame], shared: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame],
    percent: int, scratch: Scratch,
) -> DataFrame:
    """(a, b): edges with the components of all links between classes that share a bucket.

    ``classes`` is a written table (rep, bands) of ids and bucket keys. ``ready`` is told which classes
    share a bucket with others, as (rep), and gives their sets' sizes, a written table (rep, n). ``shared`` gives
    (a, b, na, nb, shared), sizes of sets and of their intersection, of a written table of pairs (a, b), and
    may leave out pairs whose sizes rule the similarity out. ``sets`` adds the distinct elements
    (own, an array of longs) to a written table (rep, comp).
    """
    entries = classes.select("rep", F.explode("bands").alias("bucket"))
    centers = entries.groupBy("bucket").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("many"))
    centers = scratch.save(centers.where("many > 1").select("bucket", "center"), "centers")
    members = scratch.save(pick(entries, centers, centers.count(), "inner", "bucket"), "members")
    scratch.drop(centers)
    sizes = ready(members.select("rep").distinct())
    around = members.where("rep != center")
    star = scratch.save(around.select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    linked = F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent
    links = components(scratch.save(shared(star).where(linked).select("a", "b"), "linked"), scratch)
    scratch.drop(star)
    rest = scratch.save(_missed(around, sizes, links, sets, percent, scratch), "rest")
    scratch.drop(members)
    more = shared(rest).where(linked).select("a", "b")
    return scratch.save(links.toDF("a", "b").unionByName(more), "links")


def _missed(
    around: DataFrame, sizes: DataFrame, links: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch
) -> DataFrame:
    """Distinct pairs (a, b) that may be linked, of different components of a bucket's members other than its center.

    Buckets are parted by size: each set is in two of a row of size classes that are as wide as the similarity
    allows, so that any two sets that it allows meet in one.
    """
    own = sizes.select("rep", "n").join(links.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left")
    step = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
    own = own.select("rep", F.coalesce("comp", "rep").alias("comp"), F.explode(F.array(step, step + 1)).alias("step"))
    rows = around.select("bucket", "rep").join(own, "rep").select(F.xxhash64("bucket", "step").alias("bucket"), "rep", "comp")
    rows = scratch.save(rows, "placed")
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("many")).where("low != high")
    mixed = scratch.save(mixed.select("bucket", (F.col("many") > SMALL).alias("large")), "mixed")
    rows = scratch.save(pick(rows, mixed, mixed.count(), "inner", "bucket"), "unsettled")
    reps = scratch.save(rows.groupBy("rep", "comp").agg(F.bool_or("large").alias("large")), "reps")
    odd = scratch.save(_sketches(sets(reps)), "sketches")
    near = _near(rows.where("not large").select("bucket", "rep", "comp").join(odd, "rep"), percent)
    return near.unionByName(_alike_by_prefix(reps.where("large").select("rep", "comp"), sets, percent, scratch)).distinct()


def _tasks(reps: DataFrame) -> int:
    return min(max(1, reps.count() // TASK_SETS), MOST_TASKS)


def _sketches(own: DataFrame) -> DataFrame:
    """(rep, n, o0, o1, ...): size and parity sketch of each set. Elements are counted where the sets are, which are not shuffled."""
    items = own.select("rep", F.explode("own").alias("h"))
    items = items.select("rep", F.shiftright("h", 6).bitwiseAND(F.lit(ODD - 1)).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    flips = [F.expr(f"coalesce(bit_xor(bit) FILTER (WHERE word = {k}), 0L)").alias(f"o{k}") for k in range(ODD)]
    return items.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), *flips)


def _near(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of small buckets that neither sizes nor sketches rule out."""
    x, y = (rows.select("bucket", *(F.col(c).alias(f"{c}_{k}") for c in rows.columns if c != "bucket")) for k in "xy")
    differ = F.lit(0)
    for k in range(ODD):
        differ = differ + F.bit_count(F.col(f"o{k}_x").bitwiseXOR(F.col(f"o{k}_y")))
    met = x.join(y, "bucket").where(
        (F.col("rep_x") < F.col("rep_y")) & (F.col("comp_x") != F.col("comp_y")) & alike("n_x", "n_y", percent)
        & (differ * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent))
    )
    return met.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()


def _alike_by_prefix(reps: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch) -> DataFrame:
    """Distinct pairs (a, b) of different components that pass the prefix filter."""
    own = sets(reps).repartition(_tasks(reps), "rep")
    items = own.select("rep", "comp", F.size("own").cast("long").alias("n"), F.explode("own").alias("h"))
    cell = F.shiftrightunsigned("h", 64 - CELL_BITS)
    cells = items.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("often"))
    first = Window.partitionBy("rep").orderBy("often", "h")
    placed = items.withColumn("cell", cell).join(F.broadcast(cells), "cell").withColumn("at", F.row_number().over(first))
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = scratch.save(placed.where((F.col("at") <= keep) & (F.col("often") > 1)).select("h", "rep", "comp", "n", "at"), "prefix")
    # Elements that only one component has make no pairs, however many members it has.
    across = prefix.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("h")
    prefix = scratch.save(prefix.join(across, "h", "left_semi"), "across")
    x, y = (prefix.select("h", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "comp", "n", "at"))) for k in "xy")
    most = 1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    met = x.join(y, "h").where(
        (F.col("rep_x") < F.col("rep_y")) & (F.col("comp_x") != F.col("comp_y")) & alike("n_x", "n_y", percent)
        & (most * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent)
    )
    return met.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()

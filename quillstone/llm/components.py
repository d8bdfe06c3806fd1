"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillstone.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return (
        moved.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns a, b) that is not the least of its component.

    Both star steps take minima by partial aggregation and join them back, so a hub of any
    degree is split by Spark's skew handling; each round is a written table, which ends its lineage.
    """
    seen, current = None, None
    source = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    while True:
        state = Observation()
        step = _small_star(_large_star(source)).observe(
            state, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        )
        nxt = scratch.save(step, "components")
        mark = tuple(state.get.get(k) for k in ("n", "x"))
        if current is not None:
            scratch.drop(current)
        source = current = nxt
        if mark == seen or not mark[0]:
            out = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out.scratch_path = current.scratch_path
            return out
        seen = mark

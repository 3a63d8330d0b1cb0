"""Connected components of a link table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.storage import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): every u hands its smallest neighbour on to its others.

    Large: to its larger neighbours. Small: edges run from larger to smaller; to the smaller ones and itself.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    out = both.join(low, "u")
    if large:
        moved = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame, *, max_rounds: int = 50) -> DataFrame:
    """From links (a, b) the table (node, component): each linked node with the smallest node it reaches.

    Every round is written to the shared folder, so lost executors cost no more than a round.
    """
    now = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v AND u IS NOT NULL AND v IS NOT NULL"), "edges")
    before = None
    for _ in range(max_rounds):
        now = materialise(_star(_star(now, True), False), "stars")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

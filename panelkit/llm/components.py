"""Connected components by alternating large-star and small-star rounds.

Each round is a few joins and minima by key; nothing of the graph reaches the
driver, and no task holds the neighbours of a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import drop_copy

from ._common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u < v. Large star: the larger neighbours of a node go to
    its smallest neighbour or itself. Small star: its smaller neighbours and
    itself go to the smallest of them."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v")
    else:
        down = edges.select(F.col("v").alias("x"), F.col("u").alias("y"))  # y < x
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        moved = down.join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).unionByName(
            least.select(F.col("m").alias("u"), F.col("x").alias("v")))
    return moved.where("u < v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """A copy of the rows (id, component) for every node of the links (a, b): ``component``
    is the smallest id that can be reached. Loops, repeats and either direction of
    a link are allowed; no links give an empty result."""
    edges = materialise(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
                        .where("u < v").distinct())
    before = None
    while True:
        last, edges = edges, materialise(_star(_star(edges, large=True), large=False))
        drop_copy(last)
        # the rounds end when every node points at its root: the edges stay the same
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
    found = materialise(found.unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()))
    drop_copy(edges)
    return found

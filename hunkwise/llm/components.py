"""Connected components of a table of links, by alternating star contraction.

No step gathers a node's neighbours into one row: minima are aggregated before
they are shuffled and joined back to the links from a written table, so that a
hub's links are split over tasks like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm._shared import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``node, component`` of the nodes of ``links(u, v)``; the component is its least node, which has no row.

    Self links are ignored, nulls are not allowed. No links give no rows.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.put(edges, f"{name}-0")
    before, step = None, 0
    while True:
        # The state of the contraction: how many links there are and their sums.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _star(both, both.where("u < v"), scratch, f"{name}-{step}a", small=False)
        scratch.drop(f"{name}-{step}")
        step += 1
        last, edges = f"{name}-{step - 1}a", _star(edges, edges, scratch, f"{name}-{step}", small=True)
        scratch.drop(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _star(links: DataFrame, moved: DataFrame, scratch: Scratch, name: str, small: bool) -> DataFrame:
    """Link the far end of each link in ``moved`` to the least neighbour of its near end ``u``."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    least = scratch.put(least, f"{name}-least")
    found = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        found = found.unionByName(least.select("u", F.col("m").alias("v")))
    out = scratch.put(found.where("u > v").distinct(), name)
    scratch.drop(f"{name}-least")
    return out

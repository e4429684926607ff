"""Reachability over edges that may form cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): ``seeds`` (node) and all that ``edges`` (src, dst) lead to.

    Each round joins the frontier only, takes away what was seen, and is a table in the shared folder, so lineage
    doesn't grow and a lost executor costs a round at most. Rounds are as many as the longest shortest path.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    seen = frontier = written(seeds.select("node").distinct(), "seeds")
    while not frontier.isEmpty():
        frontier = written(edges.join(frontier, edges["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen

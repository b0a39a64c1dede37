"""Connected components of a graph that is never in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import discard, keep


EDGES = 2048
MANY = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the smallest node reached.

    Alternates large-star and small-star steps, each a partial minimum by node and a join,
    until every node has one edge, to a node that has none: its component. Each round is
    written to the shared folder, in files of ``EDGES`` edges at least by the count of the
    round before. With over ``MANY`` edges the minima are written too, so that Spark may split
    the join of a node with very many edges. No edges give no rows.
    """
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    count, unsettled = _state(now)
    while unsettled:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        least = keep(least, "least") if count > MANY else least
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = keep(lower, "lower") if count > MANY else lower
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        following = small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        following = keep(following.coalesce(-(-count // EDGES)), "edges")
        discard(now)
        now = following
        count, unsettled = _state(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and of nodes that have two edges down or edges both down and up."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    found = nodes.agg(F.sum("down"), F.count_if(F.expr("down > 1 OR (down > 0 AND up > 0)"))).first()
    return found[0] or 0, found[1]

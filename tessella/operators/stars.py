"""Connected components by alternating large-star and small-star rewrites of the edges.

Large-star links each larger neighbour of a node to the least node of its neighbourhood; small-star does so with the smaller ones. Both only
rewrite edges, so their number never grows past a constant times the nodes, and long chains shrink as fast as short ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.skew import lookup_join
from tessella.session import materialize, release


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """``a, b`` with ``a > b``: every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    up = lookup_join(both.where("v > u"), least, ["u"], "n", 2 * total)
    return up.select(F.col("v").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` have ``a > b``: every lower neighbour of a node, and the node, is linked to the least lower neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    down = lookup_join(edges, least, ["a"], "n", total)
    return down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def star_components(pairs: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``node, group``: each node of a pair of two different nodes with the minimum of its component.

    Works for any orderable id. Raises if ``max_rounds`` alternations don't suffice; their number grows
    with the square of the logarithm of the largest component at worst.
    """
    a, b = F.col(left), F.col(right)
    start = pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = materialize(start, "edges")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        grown = large_star(edges, mark[0]).distinct()
        new = materialize(small_star(grown, mark[0]).distinct(), "edges")
        release(edges)
        edges, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("group"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct())

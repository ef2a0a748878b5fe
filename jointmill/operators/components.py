"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointmill.operators.joins import skew_safe_lookup
from jointmill.session import dropped, written


def _min_by(edges: DataFrame, key: str, other: str, both: bool) -> DataFrame:
    """Smallest neighbour (or the node itself) and number of edges of each node; both: edges are read either way."""
    e = edges.select(F.col(key).alias("n"), F.col(other).alias("o"))
    if both:
        e = e.unionByName(edges.select(F.col(other).alias("n"), F.col(key).alias("o")))
    return e.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"), F.count("*").alias("deg"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node near it; edges lo < hi."""
    m = _min_by(edges, "lo", "hi", both=True).withColumnRenamed("n", "lo")
    return skew_safe_lookup(edges, m, "lo", "deg", total).select(F.col("m").alias("lo"), "hi").where("lo < hi").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    m = _min_by(edges, "hi", "lo", both=False).withColumnRenamed("n", "hi")
    moved = skew_safe_lookup(edges, m, "hi", "deg", total).where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return moved.unionByName(m.select(F.col("m").alias("lo"), "hi")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of the component.

    Edges in either direction, repeated, with null ends or from a node to itself are allowed; the last two join
    nothing, though a node that only has an edge to itself comes out as its own root. Nodes may be of any
    orderable type. Every round moves O(edges) rows, and rounds grow with the logarithm of the longest chain. The
    result of each round is a written table, so nothing is recomputed when an executor is lost. Nothing is gathered
    on the driver but the number and checksum of the edges. An empty input gives an empty result.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    current = written(ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    start = current
    alone = start.where("lo = hi").select("lo", "hi")
    mark = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())
    current = current.where("lo < hi")
    before, tables = mark(current), []
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = written(_large_star(current, before[0]), "large")
        table = written(_small_star(large, before[0]), "small")
        dropped(large)
        tables.append(table)
        after = mark(table)
        current = table
        if len(tables) > 1:
            dropped(tables.pop(0))
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    leaves = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    lone = alone.select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return leaves.unionByName(roots).unionByName(lone.join(leaves.unionByName(roots).select("node"), "node", "left_anti").distinct())

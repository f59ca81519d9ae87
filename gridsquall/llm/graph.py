"""Connected components as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsquall.session import cut


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Each edge with the least of its ``u`` and that node's ``v``s, as ``m``."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    found = _with_minimum(edges)
    moved = found.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(found.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of a link: the least node of its component.

    Alternates the large-star and small-star steps, which shrink any component to a
    star in a logarithmic number of rounds.  Only minima are taken by key, so a node
    with very many links is summed up before the shuffle.  Each round is cut off in
    the shared checkpoint folder.  Null ends are ignored.
    """
    ends = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    for _ in range(rounds):
        edges = cut(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components have not settled")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

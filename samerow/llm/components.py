"""Connected components of a graph given by its links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from samerow.session import save


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that links lead to, for every node that has a link to another.

    Alternating stars: every node's larger neighbours are linked with its smallest neighbour, then its smaller
    ones are, until nothing changes. The number of links never grows, and a node with many neighbours is
    combined in the tasks before the shuffle. Links to oneself and null ends are passed over.
    """
    edges = save(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .distinct()
    )
    while True:
        changed = save(_small_star(_large_star(edges)))
        # Both are sets of links, so they differ if one has a link more; counts are sums of hashes.
        if _sum(changed) == _sum(edges):
            return changed.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                changed.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            )
        edges = changed


def _sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    smallest = both.groupBy(F.col("v").alias("c")).agg(F.least(F.min("u"), F.first("v")).alias("m"))
    # Each larger neighbour of a centre is linked with the centre's smallest.
    larger = edges.join(smallest, F.col("u") == F.col("c")).select("v", F.col("m").alias("u"))
    return larger.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
    joined = edges.join(smallest, F.col("v") == F.col("c"))
    # Each smaller neighbour of a centre, and the centre itself, is linked with the smallest one.
    moved = joined.filter(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.union(smallest.select(F.col("c").alias("v"), F.col("m").alias("u"))).distinct()

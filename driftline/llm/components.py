"""Connected components of a link table by alternating stars, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import cut


# Tables of at most so many short rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast by joins if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _star(edges: DataFrame, larger: bool, few: bool) -> DataFrame:
    """One step over edges (u > v). Large star: every larger neighbour of a node moves to the
    node's smallest neighbour. Small star: a node and its smaller neighbours do. Edges may come out
    more than once, but never more of them than went in."""
    if larger:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(F.broadcast(least) if few else least, "u")
    if larger:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = (joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))))
    return moved.filter("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether each component of the distinct edges is a star around its smallest node: then no node
    with a smaller neighbour has another one."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return not both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).filter("m < u AND n > 1").count()


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in `links` (a, b) the smallest id it is linked to, itself
    included. The number of rounds grows with the logarithm of the longest path."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    # Nodes are at most twice the edges, and edges do not become more.
    few = 2 * edges.count() <= BROADCAST_ROWS
    while not _settled(edges):
        edges = cut(_star(_star(edges, True, few), False, few).distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (id, component) after further `links` (a, b), between any ids. Components are followed
    as single nodes, so that the rounds see only what the new links join."""
    named, known = links, small(labels)
    for x in ("a", "b"):
        named = named.join(known.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    joined = cut(components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))))
    joined = joined.select(F.col("id").alias("component"), F.col("component").alias("now"))
    met = small(joined)
    moved = labels.join(met, "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    new = joined.join(known.select(F.col("id").alias("component")), "component", "left_anti")
    return moved.unionAll(new.select("component", "now"))

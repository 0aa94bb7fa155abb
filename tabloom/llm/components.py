"""Connected components of a link table, entirely as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each link from either end: one pass over the links, where a union reads them twice."""
    return edges.select(F.explode(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node next to it; links may come back repeated."""
    low = _both_ways(edges.select("a", "b")).groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(low, "a").select(F.least("a", "m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; *moved* where that is a new link."""
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = F.struct(F.col("m").alias("a"), F.col("a").alias("b"), F.lit(True).alias("moved"))
    own = F.struct(F.col("m").alias("a"), "b", F.lit(False).alias("moved"))
    linked = edges.join(low, "b").select(F.explode(F.array(moved, own)).alias("e")).select("e.*")
    return linked.filter("a <> b").groupBy("a", "b").agg(F.max("moved").alias("moved"))


def _all_direct(edges: DataFrame) -> bool:
    """True if every link points from the smallest node of a component to a member."""
    # without moved links each member has one link, so only a link to the start of another is left to look for
    if edges.agg(F.max("moved")).first()[0]:
        return False
    return edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").count() == 0


def member_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of *links* but the smallest ones of their components, which are the roots.

    Large-star and small-star steps alternate until every link points from the
    smallest node of a component to a member. Each round is written to the shared
    folder, so a lost executor repeats one round at most. Self-links and repeated
    links are harmless; nodes without a link do not appear.
    """
    edges = stored(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        if _all_direct(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of *links* (columns a, b of one orderable type), see :func:`member_roots`."""
    members = member_roots(links)
    return members.unionAll(members.select(F.col("root").alias("node"), "root").distinct())

"""Connected components of a graph in two columns, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promoscan.llm.common import discard, stored

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); component is its smallest node.

    Loops and repeated edges do no harm. Each round joins every node to the smallest of its
    neighbourhood, so the number of rounds grows with the logarithm of the longest path; a round
    keeps one row per edge at most and is written to the shared folder. Hot nodes are safe: the
    minimum combines before the shuffle, and the join back reads both sides from written tables, so
    that adaptive execution can split a skewed node. Raises RuntimeError if the rounds don't suffice.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stored(links, "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = _least(both)
        large = stored(_star(both, first, "v > u"), "large-star")
        second = _least(large)
        before, links = links, stored(_star(large, second, None), "small-star")
        discard(before, first, large, second)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components: too many rounds")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _least(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return stored(least.select("u", F.least("u", "m").alias("m")), "least")


def _star(links: DataFrame, least: DataFrame, keep: str | None) -> DataFrame:
    """Link neighbours v of u, and u itself, to the smallest of u's neighbourhood."""
    joined = links.join(least, "u")
    out = joined.filter(keep) if keep else joined
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep is None:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()

"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A round at least halves the paths, so 2^60 nodes need no more than this.
MAX_ROUNDS = 64


def _stars(near: DataFrame) -> DataFrame:
    """near (a, b) with the least b of each a as least_b. A node may have most of all links, so the minimum is
    summed up before the shuffle and joined back; that join splits a hot node's rows."""
    least = near.groupBy("a").agg(F.min("b").alias("least_b"))
    return near.join(least, "a")


def _canonical(links: DataFrame) -> DataFrame:
    """Each link once, as (a, b) with a > b."""
    return (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b) whose component has a smaller node; component is the
    smallest node reachable. Nodes that are their own component's smallest, and nodes without links, are left out.

    Links may repeat, run both ways and from a node to itself; a link with a null end is no link.
    """
    now = materialise(_canonical(links.select("a", "b").where("a is not null and b is not null")), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "least_b").alias("b"))
        small = _stars(_canonical(large))
        joined = small.select("a", F.col("least_b").alias("b")).unionByName(
            small.select(F.col("b").alias("a"), F.col("least_b").alias("b"))
        )
        now = materialise(_canonical(joined), "links")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))

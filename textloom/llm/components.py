"""Connected components of a graph given as a table of links.

Alternates two steps until nothing changes: every node hands the smallest neighbour to its larger
neighbours, then to its smaller ones. Paths halve each time, so the number of rounds grows
with the logarithm of the longest path. Each step is an aggregation and a join; a
node with very many links is aggregated before the shuffle and its join is one that the adaptive
planner splits. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import checkpointed


def _smallest(links: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _hand_to_larger(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both)
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _hand_to_smaller(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    joined = down.join(least, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node with a link. ``links`` has u and v.

    Null ends and links of a node with itself are left out.
    """
    current = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        current = checkpointed(_hand_to_smaller(_hand_to_larger(current)), "links")
        # The same links again: every node points at the root of its star.
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.groupBy("u").agg(F.min("v").alias("component"))
    roots = stars.select("component").distinct()
    found = stars.select(F.col("u").alias("node"), "component").unionByName(roots.select(F.col("component").alias("node"), "component"))
    # Written, so that the plans that use it stay small.
    return checkpointed(found, "components")

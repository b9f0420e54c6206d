"""The order of what names its successor: pages that give the cursor of the next one, items that reply to one another.

Ranking by pointer doubling. After k rounds every node knows the node 2**k steps ahead, and the first 2**k nodes of each chain
have their place; a round joins both with themselves. So a chain of n nodes takes about log2(n) rounds
of joins on (node, node) pairs, and nothing walks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gone, kept


def places(links: DataFrame, starts: DataFrame, node: str = "node", then: str = "then", chain: str = "chain", most: int | None = None) -> DataFrame:
    """chain, node, place (from 0) of every node that a walk from a chain's start would come to, kept as a table.

    ``links`` (node, then) names the successor of a node, null at an end; ``starts`` (chain, node) where each chain begins. A walk ends at
    a node that has no row in links, after ``most`` nodes, or before a node that it has been to. Of a node with several successors the least one
    follows; several nodes may lead to one. Chains may share nodes; of several starts of a chain a node's least place counts. Null nodes, chains
    that start nowhere and nodes that nothing leads to are left out.
    """
    # The jump of a node is null where the chain ends before that many steps.
    ahead = kept(links.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(then).alias("jump")))
    found = kept(starts.select(F.col(chain).alias("chain"), F.col(node).alias("node")).join(ahead.select("node"), "node", "left_semi").groupBy("chain", "node").agg(F.lit(0).cast("bigint").alias("place")))
    done, step = found.isEmpty(), 1
    while not done:
        if most is not None and step >= most:
            break
        # What stands ``step`` behind the nodes that have a place, unless it has one itself.
        further = found.join(ahead, "node").where("jump IS NOT NULL").select("chain", F.col("jump").alias("node"), (F.col("place") + step).alias("place")).join(ahead.select("node"), "node", "left_semi")
        fresh = kept(further.groupBy("chain", "node").agg(F.min("place").alias("place")).join(found.select("chain", "node"), ["chain", "node"], "left_anti").select("chain", "node", "place"))
        if fresh.isEmpty():
            gone(fresh)
            break
        was, found = found, kept(found.unionByName(fresh))
        gone(was)
        gone(fresh)
        was = ahead
        ahead = kept(ahead.join(ahead.select(F.col("node").alias("jump"), F.col("jump").alias("_further")), "jump", "left").select("node", F.col("_further").alias("jump")))
        gone(was)
        step *= 2
    gone(ahead)
    return found if most is None else found.where(F.col("place") < most)

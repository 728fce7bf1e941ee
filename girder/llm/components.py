"""Connected components of an edge table, by random-mate contraction.

Each round hooks every vertex to the neighbour (or itself) of the least priority, a hash that changes with
the round, follows these pointers twice, replaces vertices by what they point to and drops loops. Priorities fall along
pointers, so there are no cycles; a star or a dense group shrinks to one vertex in a round or two and a path
by a constant factor. Every round is written to the shared folder; nothing is gathered on the driver but one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import staged


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the same node throughout a component."""
    both = edges.where("a <> b").select("a", "b")
    pairs = staged(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.lit(1).alias("w")).select("a", "b"), "edges")
    total: DataFrame | None = None
    for k in range(rounds):
        if pairs.isEmpty():
            break

        def rank(c: str, k: int = k):
            return F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("r"), F.col(c).alias("v"))

        hook = pairs.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a")))["v"].alias("p"))
        hook = staged(hook, "hook")
        for _ in range(2):
            nxt = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = hook.join(nxt, "p").select("a", F.col("q").alias("p"))
        hook = staged(hook, "hook")
        if total is None:
            total = hook.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            step = hook.select(F.col("a").alias("root"), F.col("p").alias("to"))
            total = total.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        total = staged(total, "roots")
        left = hook.select("a", F.col("p").alias("pa"))
        right = hook.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = pairs.join(left, "a").join(right, "b").where("pa <> pb")
        pairs = staged(moved.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.lit(1).alias("w")).select("a", "b"), "edges")
    else:
        raise RuntimeError("components did not settle")
    if total is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return total

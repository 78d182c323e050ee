"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutmill.session import keep


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node of its component.

    Each round takes the least root among a node's neighbours and then follows
    that root's own root, so the way to the least node is halved; rounds are
    written as tables in the shared folder. Nothing but the count of changed
    nodes reaches the driver.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = keep(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    for _ in range(max_rounds):
        offers = both.join(roots, both["b"] == roots["node"]).groupBy(both["a"].alias("node")).agg(F.min("root").alias("offer"))
        better = roots.join(offers, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("offer", "root")).alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        moved = keep(better.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("beyond", "root")).alias("root")))
        roots = moved.select("node", "root")
        if moved.where(~F.col("old").eqNullSafe(F.col("root"))).isEmpty():
            return roots
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

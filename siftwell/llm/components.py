"""Connected components of a table of links, by contraction: every root hooks onto its least neighbour, trees are flattened by pointer jumps, and
links between roots are what the next round sees; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.tables import drop, keep

#: Two rounds at least halve the roots that still have links: one that nothing hooked onto has a lesser neighbour in the next round and hooks itself.
#: A jump halves the depth of a tree. So both bounds are beyond any table; to reach one is an error.
ROUNDS, JUMPS = 128, 64


def flat(hooks: DataFrame) -> DataFrame:
    """Of hooks (node, label) whose labels are nodes, none greater than its own node: node and the root that its labels lead to. Drops hooks."""
    for _ in range(JUMPS):
        up = hooks.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = keep(hooks.join(up, "label").select("node", F.col("label").alias("old"), F.col("up").alias("label")), "hooks")
        moved = new.filter("old <> label").count()
        drop(hooks)
        hooks = new.select("node", "label")
        if not moved:
            return hooks
    raise RuntimeError(f"trees of links are not flat after {JUMPS} jumps")


def connected(links: DataFrame) -> DataFrame:
    """node, label (the least node it is linked to, itself included) for every node of links (a, b). No links: no rows."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = keep(both, "links")
    now = None
    for _ in range(ROUNDS):
        hooks = flat(keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "hooks"))
        to = [hooks.select(F.col("node").alias(k), F.col("label").alias(f"root_{k}")) for k in ("a", "b")]
        left = both.join(to[0], "a").join(to[1], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        left = keep(left.filter("a <> b").distinct(), "links")
        drop(both)
        both = left
        if now is None:
            now = hooks
        else:
            new = now.join(hooks.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
            new = keep(new.select("node", F.coalesce("root", "label").alias("label")), "labels")
            drop(now)
            drop(hooks)
            now = new
        if not both.count():
            drop(both)
            return now
    raise RuntimeError(f"links are left after {ROUNDS} rounds")

"""Connected components of links that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks a few steps, and
    contracts the links. Nodes that still have links at least halve, so rounds grow with the
    logarithm of the longest chain. Sums per node are taken before the shuffle, so a node with
    very many links is no burden. Rounds are cut by written tables.
    """
    a, b = F.col("a"), F.col("b")
    links = materialize(links.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    roots = materialize(links.select(a.alias("node")).union(links.select(b.alias("node"))).distinct()
                        .withColumn("root", F.col("node")), "roots")
    while not links.isEmpty():
        both = links.select(a.alias("node"), b.alias("other")).union(links.select(b.alias("node"), a.alias("other")))
        hooks = materialize(both.groupBy("node").agg(F.min("other").alias("other"))
                            .select("node", F.least("node", "other").alias("up")), "hooks")
        step = hooks.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
        for _ in range(2):
            hooks = hooks.join(step, F.col("up") == F.col("n2"), "left").select("node", F.coalesce("up2", "up").alias("up"))
        hooks = materialize(hooks, "hooks")
        roots = materialize(roots.join(hooks.select(F.col("node").alias("n2"), "up"), F.col("root") == F.col("n2"), "left")
                            .select("node", F.coalesce("up", "root").alias("root")), "roots")
        for end in ("a", "b"):
            links = links.join(hooks.select(F.col("node").alias("n2"), "up"), F.col(end) == F.col("n2")).withColumn(
                end, F.col("up")).select("a", "b")
        links = materialize(links.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(),
                            "links")
    return roots

"""Connected components of a graph given as links, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeshare.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """From links ``a``, ``b`` (longs) to ``node``, ``root``: the smallest node that it reaches.

    Nodes without a link to another node are left out. Each round hooks every node to its smallest
    neighbour, follows the hooks three times over, and replaces both ends of each link by the node
    they led to; links within one group vanish. Rounds grow with the logarithm of the longest
    path. Minima are taken before the shuffle, so a node with a third of all links costs no more
    than others; nothing but a count comes to the driver, and each round ends in a written table.
    """
    links = stored(
        links.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links",
    )
    labels = None
    while links.limit(1).count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
            .select("node", F.least("node", "low").alias("root")), "hooks",
        )
        for _ in range(3):
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            hooks = hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        hooks = stored(hooks, "hooks")
        to = lambda end: hooks.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        links = stored(
            links.join(to("a"), "a", "left").join(to("b"), "b", "left")
            .select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = stored(
                labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels",
            )
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels

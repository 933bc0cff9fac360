"""Connected components of links, by contraction.

Every round each root that has a smaller neighbour takes the smallest as its parent; the forest is flattened by
pointer jumping; links are rewritten to roots and those inside one tree go. The number of roots with links at least
halves each round. Tables are checkpointed each round; nothing but counts reaches the driver.

Defined results: links with a null end link nothing; a node's link to itself gives it no row; repeated links count once;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import durable, stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of any comparable type. Per node that has a link: node, root (the smallest node reachable)."""
    ordered = lambda d: d.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct()
    edges = stored(ordered(links))
    nodes = edges.select(F.col("lo").alias("node")).union(edges.select("hi")).distinct()
    labels = nodes.select("node", F.col("node").alias("root"))
    while edges.limit(1).count():
        parents = durable(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        while True:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = durable(parents.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
            parents = jumped.select("node", "root")
            if not jumped.filter("moved").limit(1).count():
                break
        above = parents.select(F.col("node").alias("key"), F.col("root").alias("higher"))
        labels = durable(labels.join(above, F.col("root") == F.col("key"), "left").select("node", F.coalesce("higher", "root").alias("root")))
        low = edges.join(above, F.col("lo") == F.col("key"), "left").select(F.coalesce("higher", "lo").alias("a"), "hi")
        both = low.join(above, F.col("hi") == F.col("key"), "left").select("a", F.coalesce("higher", "hi").alias("b"))
        edges = stored(ordered(both))
    return labels

"""Connected components of an edge table, without the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import discard, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b), both of one orderable type -> (node, root), the smallest node that is reachable.

    Alternates large-star and small-star steps; each step sends a node's neighbours to their
    smallest one, so the depth of a chain falls geometrically. Aggregates only, no collected
    group: the smallest neighbour is a min() with map-side combining. Each round is written to
    the shared folder, so a lost executor repeats one round at most. An empty table gives an
    empty table; loops and repeated edges do no harm. Nodes that no edge names are not returned.
    """
    links = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    links = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u gets u's smallest neighbour
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and u itself, gets the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        # a forest of stars: each u has one v, and no v has one itself
        deep = after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        many = after.groupBy("u").count().where("count > 1").limit(1).count() if not deep else 1
        discard(links)
        links = after
        if not many:
            break
    else:
        raise RuntimeError("components: the rounds allowed did not suffice")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()

"""Connected components of a graph of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    Every round hooks each node onto the smallest of its neighbours, follows that pointer once
    more, and contracts the graph to the nodes so named; links inside a node vanish.  Each
    round writes its links to the shared folder, so lineage stays short and nothing is gathered
    on the driver but a count.  A hub's links are combined before they shuffle (a minimum), and
    in joins Spark splits the partitions that hold one.  Null ends and loops are ignored; no
    links give no rows."""
    spark = links.sparkSession
    two = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    edges = written(two.where("ok AND a <> b").select("a", "b").distinct(), "links")
    moved: list[DataFrame] = []
    named = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        again = low.select(F.col("node").alias("to"), F.col("to").alias("further"))
        hooked = written(low.join(again, "to").select("node", F.col("further").alias("to")), "hooks")
        moved.append(hooked)
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(hooked.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end).drop(end).withColumnRenamed(f"{end}_to", end)
        left = written(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        forget(edges)
        edges = left
        if named is None:
            named = hooked.select("node", F.col("to").alias("component"))
        else:
            step = hooked.select(F.col("node").alias("component"), F.col("to").alias("_next"))
            named = named.join(step, "component", "left").select("node", F.coalesce("_next", "component").alias("component"))
    if named is None:
        return spark.createDataFrame([], "node bigint, component bigint")
    return named

"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import join_sized, written

#: Small tables are written in few files.
ROWS_PER_FILE = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node with an edge (u, v); component is its smallest node.

    Each round points every node to its smallest neighbour, follows the pointers to their ends by
    doubling, and contracts the graph to those ends; edges within an end vanish. The number of nodes that
    have edges halves at least, so there are few rounds. Hubs are dealt to several tasks, or their table is small enough to broadcast (join_sized).
    """
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while (n := edges.count()) or labels is None:
        parts = 1 + n // ROWS_PER_FILE
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = written(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "parents")
        nodes = parents.count()
        while True:
            ends = parents.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = written(join_sized(parents, ends, "p", nodes, nodes).coalesce(parts), "parents")
            parents = jumped.select("u", F.col("q").alias("p"))
            if not jumped.where("p <> q").limit(1).count():
                break
        if labels is None:
            labels, all_nodes = parents.select(F.col("u").alias("node"), F.col("p").alias("component")), nodes
        else:
            own = parents.select(F.col("u").alias("component"), F.col("p").alias("q"))
            labels = join_sized(labels, own, "component", all_nodes, nodes, "left").select("node", F.coalesce("q", "component").alias("component"))
            labels = written(labels.coalesce(1 + all_nodes // ROWS_PER_FILE), "labels")
        left = join_sized(edges, parents.withColumnRenamed("p", "pu"), "u", n, nodes)
        right = join_sized(left, parents.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v", n, nodes)
        edges = written(right.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    return labels

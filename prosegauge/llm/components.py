"""Connected components by hooking and shortcutting parents, as tables.

Every node has a parent, at first itself. In each round the least grandparent among a node's neighbours hooks the node and its
parent, and each node moves to its grandparent; trees of parents shrink to stars of the smallest node. Tables of
parents have one row for each node. A node with very many links, or a parent of very many nodes, is a skewed join key
between two plain shuffles, which Spark splits; minima are added up before they are shuffled, so no task gathers a hub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, label): for each node of edges (a, b) the smallest node that its links reach; nodes without links are absent.

    Ends when no parent changes, after about log2 of the longest path rounds; only the number of changed parents comes to the
    driver."""
    links = checkpointed(edges.where("a != b").select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct())
    # the first round of a star around each node: its smallest neighbour
    parents = checkpointed(links.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent"), F.lit(True).alias("changed")))
    for _ in range(most_rounds):
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        grand = parents.select("node", "parent").join(above, "parent").select("node", "parent", "grand")
        heard = links.join(grand.select(F.col("node").alias("v"), "grand"), "v").groupBy("u").agg(F.min("grand").alias("least"))
        told = grand.join(heard.withColumnRenamed("u", "node"), "node").withColumn("least", F.least("least", "grand"))
        sent = told.select(F.explode(F.array(F.struct("node", "least", F.col("parent").alias("was")), F.struct(F.col("parent").alias("node"), "least", F.lit(None).cast(parents.schema["parent"].dataType).alias("was")))).alias("h")).select("h.*")
        parents = checkpointed(sent.groupBy("node").agg(F.min("least").alias("parent"), F.min("was").alias("was")).select("node", "parent", (F.col("parent") != F.col("was")).alias("changed")))
        if not parents.where("changed").head(1):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return parents.select("node", F.col("parent").alias("label"))

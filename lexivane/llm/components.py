"""Connected components of a graph given as an edge table, by alternating star contractions.

Each round hangs the larger neighbours of every node on its smallest neighbour, then the smaller ones likewise,
until every node hangs on the smallest of its component. A node with very many edges is only ever the key of a
minimum, which is combined before the shuffle, and of a join whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hang(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Hang the neighbours ``b`` of each ``a`` on the smallest of them and ``a``."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    met = pairs.join(least, "a")
    moved = met.where("b > a") if larger_only else met.where("b <> least")
    hung = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hung if larger_only else hung.unionByName(least.where("a <> least").select("a", F.col("least").alias("b")))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node of it.

    Edges may repeat and come in either direction; those with a null end or equal ends count as none.
    """
    start = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    now = stored(start.where(f"{left} is not null and {right} is not null and a <> b").distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (seen["n"], seen["h"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select("b", "b").distinct().toDF("node", "component"))
        state = (seen["n"], seen["h"])
        now = stored(_hang(_hang(_both(now), True), False).distinct(), "edges")

"""Connected components of a graph of numbered nodes, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.session import Stored


def _contract(edges: DataFrame, larger: bool) -> DataFrame:
    """Tie each node's larger (or smaller) neighbours to the least of its neighbours and itself."""
    if larger:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    tied = both.join(least, "a")
    if larger:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of `edges` (a, b: long, a <> b).

    Nothing of the graph reaches the driver but a count and a sum for each round; every round is a
    stored table, which replaces the one before. No edges: no rows. Nulls are not allowed, repeated
    edges are.
    """
    tables = Stored(edges.sparkSession)
    now = tables.put(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = None
    while True:
        now = tables.put(_contract(_contract(now, larger=True), larger=False), "edges")
        found = now.agg(
            F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.max("a")
        ).first()
        if tuple(found) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = tuple(found)

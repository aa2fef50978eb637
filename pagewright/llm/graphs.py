"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import scratch_folder


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest name it was merged into) of every node that has an edge.

    `edges` has the columns a and b.  In each round every node takes the smallest name among
    itself and its neighbours, edges follow their ends, and loops and repeats go; the number of
    edges falls quickly and nothing but the next round's tables is kept.  Rounds are written to
    the shared scratch folder, so a lost executor repeats one round at most.  Minima are combined
    before they are shuffled, and joins are left to adaptive execution, which splits the rows of
    a node that a third of all edges touch.
    """
    spark = edges.sparkSession

    def written(frame: DataFrame, name: str) -> DataFrame:
        folder = scratch_folder(spark, name)
        frame.write.parquet(folder)
        return spark.read.schema(frame.schema).parquet(folder)

    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        moved = written(
            both.groupBy("node").agg(F.min("other").alias("least")).select(
                "node", F.least("node", "least").alias("to")), "moved")
        to_a = moved.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        to_b = moved.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = written(
            edges.join(to_a, "a").join(to_b, "b").where("to_a <> to_b").select(
                F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if labels is None:
            labels = moved.select("node", F.col("to").alias("component"))
        else:
            labels = written(
                labels.join(moved.select(F.col("node").alias("component"), "to"), "component", "left").select(
                    "node", F.coalesce("to", "component").alias("component")), "labels")
    if labels is None:
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    return labels

"""Connected components of a graph of hashed node ids, without any node's links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); nodes have one label exactly if connected.

    Each round renames every node to its smallest neighbour, or itself. An edge (a, b) becomes
    (name a, name b), so names stay connected as the nodes were, and names of different components
    never meet. Ids are hashes, so a round leaves a fraction of the names; stars take one round.
    """
    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        name = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).select("a", "to"), "names")
        old = labels
        if labels is None:
            labels = materialise(name.select(F.col("a").alias("node"), F.col("to").alias("label")), "labels")
        else:
            moved = name.select(F.col("a").alias("label"), "to")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = materialise(labels, "labels")
        renamed = edges.join(name, "a").select("b", F.col("to").alias("x")).join(name.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("to").alias("b"))
        new = materialise(renamed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(edges, name, *([old] if old is not None else []))
        edges = new
        if not edges.limit(1).count():
            discard(edges)
            return labels

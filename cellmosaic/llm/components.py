"""Connected components of an edge table, by contraction: hook each node to its smallest neighbour, shorten the paths, merge, repeat.

No edge or component ever comes to the driver; only counts do. Hot nodes cost nothing special: a node's smallest neighbour is a partial
aggregate, and the joins have one row a node on one side, so Spark splits the other side where it is skewed.

Nodes are of any type that has an order. An edge from a node to itself says nothing; repeated edges count once. Without edges there are no rows; edges have no nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (``a, b``); ``comp`` is one node of the component, the same for all of its nodes."""
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("p")), "parents")
        while True:
            up = parent.select(F.col("x").alias("p"), F.col("p").alias("q"))
            jumped = written(parent.join(up, "p").select("x", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "parents")
            parent = jumped.select("x", "p")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select(F.col("x").alias("node"), F.col("p").alias("comp"))
        else:
            hop = parent.select(F.col("x").alias("comp"), F.col("p").alias("to"))
            labels = written(labels.join(hop, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        a, b = parent.select(F.col("x").alias("a"), F.col("p").alias("pa")), parent.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        edges = written(edges.join(a, "a").join(b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels

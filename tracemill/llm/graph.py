"""Connected components by repeated contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _key(x: F.Column) -> F.Column:
    """A bijection of longs that scatters neighbours (xor-shift)."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def _down(edges: DataFrame) -> DataFrame:
    """Edges between different labels, from the greater to the lesser, each once."""
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b: longs).

    Every round hooks each label to its least neighbour, halves the chains and
    replaces labels in the edges, in an order scattered by hash, so that chains
    shrink by a factor; tables are written between rounds.  A label's rows never
    meet in one task: minima are pre-aggregated, and the joins have unique keys
    on one side.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.withColumn("label", _key(F.col("node")))
    links = written(_down(edges.select(_key(F.col("a")).alias("a"), _key(F.col("b")).alias("b"))), "links")
    while not links.isEmpty():
        parent = written(links.groupBy("hi").agg(F.min("lo").alias("up")), "parents")
        above = parent.select(F.col("hi").alias("up"), F.col("up").alias("top"))
        hook = written(parent.join(above, "up", "left").select("hi", F.coalesce("top", "up").alias("to")), "hooks")
        links = written(
            _down(
                links.join(hook.withColumnRenamed("hi", "h1").withColumnRenamed("to", "t1"), F.col("hi") == F.col("h1"), "left")
                .join(hook.withColumnRenamed("hi", "h2").withColumnRenamed("to", "t2"), F.col("lo") == F.col("h2"), "left")
                .select(F.coalesce("t1", "hi").alias("a"), F.coalesce("t2", "lo").alias("b"))
            ),
            "links",
        )
        labels = written(
            labels.join(hook, F.col("label") == F.col("hi"), "left").select("node", F.coalesce("to", "label").alias("label")),
            "labels",
        )
    return labels

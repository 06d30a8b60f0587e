"""Connected components by contraction, in joins and aggregations over shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _contracted(edges: DataFrame) -> DataFrame:
    """Distinct edges a < b."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) long to (node, comp): the smallest node that each linked node reaches.

    In a turn every node points to its smallest neighbour if that is smaller; pointers are followed to
    their roots by doubling, each tree becomes its root, and only edges between different roots go on,
    so at least half of the nodes go in a turn. A hub's links are joined and aggregated with partial
    sums, never gathered. Null ends and self links are ignored; an empty table gives no rows.
    """
    edges, labels = written(_contracted(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))), None
    while True:
        near = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("up")))
        up = written(near.groupBy("node").agg(F.min("up").alias("up")))
        while True:
            after = written(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            dropped(up)
            up = after
            if up.where("moved").isEmpty():
                break
        if labels is None:
            new = written(up.select("node", F.col("up").alias("comp")))
        else:
            new = written(labels.join(up.select(F.col("node").alias("comp"), "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
            dropped(labels)
        labels = new
        ends = [up.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in "ab"]
        left = written(_contracted(edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))))
        dropped(edges, up)
        edges = left
        if edges.isEmpty():
            dropped(edges)
            return labels

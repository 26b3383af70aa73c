"""Connected components of an edge table by smallest labels; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its component.

    Each round a node takes the smallest label next to it, then the label of its label, so labels travel twice
    as far from round to round: few rounds for stars, logarithmically many for chains. Every round is cut.
    """
    ends = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")), F.struct(F.col(a).alias("u"), F.col(a).alias("v")), F.struct(F.col(b).alias("u"), F.col(b).alias("v")))
    e = cut(edges.select(F.explode(ends).alias("e")).select("e.*").distinct(), "edges")
    labels = cut(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "labels")
    mark = _mark(labels)
    while True:
        near = e.join(labels, e["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("m"))
        far = labels.select(F.col("node").alias("m"), F.col("component").alias("far"))
        labels = cut(near.join(far, "m").select(F.col("u").alias("node"), F.col("far").alias("component")), "labels")
        now = _mark(labels)
        if now == mark:
            return labels
        mark = now


def _mark(labels: DataFrame) -> tuple:
    return tuple(labels.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "component"))).first())

"""Connected components of links between nodes, without the driver or one task ever holding them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of each node in links (a, b).

    Each round takes the least label among a node's neighbours and then that label's own label, so that paths halve; it
    ends when nothing changes.  Every round's labels are written to the shared folder.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        labels, moved = labels.select("node", "label"), labels
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "least").alias("least"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = written(step.join(jump, step["least"] == jump["via"]).select("node", F.least("least", "far").alias("label"), (F.least("least", "far") != F.col("label")).alias("moved")))
        discard(moved)
        if new.where("moved").isEmpty():
            discard(both)
            labels = written(new.select("node", "label"))
            discard(new)
            return labels
        labels = new

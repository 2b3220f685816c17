"""Connected components of an edge table by smallest labels and jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a, b): the smallest node of the
    component. Each round takes the smallest label among the neighbours and
    then the label's own label; it ends when nothing changes. Every round is
    written to the shared folder; no part of the graph reaches the driver.

    Loops and repeated edges do not matter; an empty edge table has no nodes."""
    both = written(edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                                 F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
                   .distinct(), "components-edges")
    label = written(both.groupBy("u").agg(F.min("v").alias("low"))
                    .select(F.col("u").alias("node"), F.least("u", "low").alias("label")), "components-0")
    while True:
        seen = (both.join(label.select(F.col("node").alias("v"), F.col("label").alias("next")), "v")
                .groupBy("u").agg(F.min("next").alias("next")))
        near = label.join(seen.withColumnRenamed("u", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "next").alias("label"))
        hop = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = written(near.join(hop, "label").select("node", "old", F.least("label", "far").alias("label")), "components")
        changed = new.where("label <> old").limit(1).count()
        drop_written(label)
        label = new.select("node", "label")
        label.scratch = new.scratch
        if not changed:
            drop_written(both)
            return label

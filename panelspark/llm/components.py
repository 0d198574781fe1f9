"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm._shared import discard, written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (and ``same``, true) for every node of ``links`` (columns ``a, b``).

    The component is the smallest node of it.  A round gives every node the
    smallest label among its neighbours and then that label's own label, so long
    chains shorten by more than half a round.  Every round is written to the
    shared folder; only a count comes to the driver.  A node that is null is in no
    link: its rows join nothing.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("nearest"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("component").alias("before"), F.least("component", "nearest").alias("label"))
        lower = written(lower, "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = written(lower.join(jump, "label", "left").select("node", F.least("label", "further").alias("component"), F.least("label", "further").eqNullSafe(F.col("before")).alias("same")), "labels")
        discard(labels, lower)
        labels = after
        if after.where(~F.col("same")).isEmpty():
            discard(both)
            return labels

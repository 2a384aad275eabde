"""Connected components of a link table, by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import drop_stage, stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, comp) for every node of `links`; comp is the smallest node reachable.

    Each round takes the least label among a node and its neighbours and then follows the label's own label, so long
    chains halve. Every round is written to the shared folder, and only the last one, which the result reads, stays there; the
    caller drops it. No links give no rows; repeated links and loops are harmless.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "comp"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("comp").alias("least"))
        )
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "least").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = stage(
            step.join(jump, "next").select("node", F.least("next", "far").alias("comp"), (F.least("next", "far") < F.col("comp")).alias("moved")),
            "labels",
        )
        moved = not new.where("moved").isEmpty()
        drop_stage(labels)
        labels = new.select("node", "comp")
        if not moved:
            drop_stage(both)
            return labels

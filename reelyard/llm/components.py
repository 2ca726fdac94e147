"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from reelyard.storage import keep, release


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the links (a, b), by labels that spread to neighbours
    and then follow their own label, until none changes. A node with many links is a key of aggregates that are combined
    before the shuffle; no links or components pass through the driver."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = keep(ends.distinct(), "links")
    labels, new = keep(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels"), None
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "theirs").alias("component"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = spread.join(hop, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        seen = Observation()
        before, new = new, keep(moved.observe(seen, F.count_if(F.col("old") != F.col("component")).alias("changed")), "labels")
        release(before, labels)
        labels = new.select("node", "component")
        if not seen.get["changed"]:
            release(both)
            return labels

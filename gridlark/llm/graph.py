"""Connected components as DataFrame jobs; no links ever reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import discard, scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every end of an edge; comp is the smallest id reachable.

    Each round takes the smallest label among neighbours, then the label of that label, so paths halve each round.
    Rows are combined before each shuffle; joins on a hub's key are left to Spark's skew handling."""
    pairs = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = scratch(pairs.union(pairs.select("b", "a")).toDF("src", "dst").distinct())
    labels = scratch(links.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("comp")))
    while True:
        near = links.join(labels, links.dst == labels.id).groupBy("src").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.id == near.src).select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        after = scratch(step.join(up, "comp", "left").select("id", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "was"))
        discard(labels)
        labels = after
        if not labels.where("comp <> was").limit(1).count():
            discard(links)
            return labels.select("id", "comp")

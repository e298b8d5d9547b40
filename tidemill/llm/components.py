"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import forget, meet, stored

#: Links that one member of a group gets in ``tree``.
FAN = 32


def tree(members: list) -> list[tuple]:
    """Links that connect ``members``, none of which has more than FAN + 1: each is linked to one that comes before it."""
    return [(members[(i - 1) // FAN], members[i]) for i in range(1, len(members))]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, label) for every end of ``links`` (a, b): label is the smallest end that v is connected to.

    Each round takes the smallest label among the neighbours, then that label's own label, so that chains shrink by
    halves. Labels are written to the shared folder between rounds. Ends with many links and labels with many ends are
    dealt out to several tasks.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    total = both.count()
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select(F.col("a").alias("v"), F.least("a", "m").alias("label"), "degree"), "labels")
    for _ in range(most_rounds):
        near = meet(both, labels.select(F.col("v").alias("b"), "label", "degree"), "b", "degree", "a", total).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels.v == near.a).select("v", F.least("label", "m").alias("label"), F.col("label").alias("old"), "degree")
        step = stored(lower, "lower")
        used = step.groupBy("label").agg(F.count("*").alias("used"))
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("next")).join(used, "label")
        new = meet(step, jump, "label", "used", "v", total)
        new = stored(new.select("v", F.col("next").alias("label"), "degree", (F.col("next") != F.col("old")).alias("moved")), "labels")
        forget(step)
        forget(labels)
        labels = new
        if labels.where("moved").isEmpty():
            return labels.select("v", "label")
    raise RuntimeError(f"labels still move after {most_rounds} rounds")

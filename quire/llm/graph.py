"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b): component is the smallest id reachable.

    Each round gives every id the smallest label among its neighbours and then follows the labels' own labels, so chains
    shorten by halves. Every round is written to the shared folder. Self links and repeated links are allowed; ids that
    occur in no link are not returned; an empty table gives an empty table.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.where("a is not null and b is not null").distinct(), "links")
    if both.isEmpty():
        return both.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        closer = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        moved = saved(closer.join(jump, "mid", "left").select("id", "old", F.least("mid", "far").alias("component")), "labels")
        labels = moved.select("id", "component")
        if moved.where("old <> component").isEmpty():
            return labels

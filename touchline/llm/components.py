"""Connected components of a table of links, by alternating star joins in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.base import cut_lineage


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (least node reachable) for every node in a link (``a``, ``b``).

    Each round every node points at the least label among itself and its neighbours, then at that label's own label, so paths
    shrink by more than half. Only the table of labels moves, one row per node; hot nodes are pre-aggregated before the shuffle.
    Stops when nothing changes. An empty table gives an empty one. Raises after ``rounds`` rounds (paths of 2^``rounds`` nodes).
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root"))
    labels = cut_lineage(labels)
    for _ in range(rounds):
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        told = labels.join(heard, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", "heard").alias("now"))
        up = labels.select(F.col("node").alias("via"), F.col("root").alias("above"))
        after = told.join(up, F.col("now") == F.col("via"), "left").select("node", F.col("root").alias("was"), F.least("now", "above").alias("root"))
        after = cut_lineage(after)
        if after.where("root <> was").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
    raise RuntimeError(f"labels still change after {rounds} rounds")

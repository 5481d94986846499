"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import discard, stage_at


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of links(a, b).

    Each round a node takes the least label among its neighbours' and then the label of its label, so paths halve; a round is two joins and
    a combined aggregate, written to the shared folder; a round's table goes when the next one's is there. A node with very many links is one key of
    joins that adaptive execution splits.
    """
    spark = links.sparkSession
    edges, kept = stage_at(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels, last = stage_at(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("lower"))
        above = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        moved, folder = stage_at(lower.join(above, F.col("lower") == F.col("up")).select("node", F.least("lower", "top").alias("label"), (F.least("lower", "top") < F.col("was")).alias("changed")))
        discard(spark, last)
        labels, last = moved.select("node", "label"), folder
        if moved.where("changed").isEmpty():
            discard(spark, kept)
            return labels

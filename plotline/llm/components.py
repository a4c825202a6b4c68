"""Connected components of a frame of links, by smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.session import durable


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every end of the links (a, b): the smallest vertex reachable.

    Each round takes the smallest label among the neighbours and then that vertex's own
    label, so distances halve; rounds end when no label changes. Minima are combined before
    the shuffle and joins may be split, so a vertex with many links is no one task's load.
    """
    both = durable(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                   .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct())
    labels = durable(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")))
    while True:
        near = (both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near")))
        lower = labels.join(near, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("far"))
        moved = durable(lower.join(jump, "low", "left").select(
            "v", "was", F.least("low", F.coalesce("far", "low")).alias("label")))
        labels = moved.select("v", "label")
        if moved.where("label < was").isEmpty():
            return labels

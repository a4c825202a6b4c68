"""Connected components of a table of links, by smallest labels and label jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.session import durable


def components(links: DataFrame) -> DataFrame:
    """(v, label): for every end of the links (a, b) the smallest vertex it is joined with.

    A round takes the smallest label next to each vertex and then the label of that label, so
    rounds grow with the logarithm of the longest path. A vertex with very many links is
    combined before the shuffle.
    """
    near = durable(links.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(
        links.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct())
    labels = durable(near.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")))
    while True:
        lowest = near.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("label").alias("_low"))
        stepped = labels.join(lowest, "v").select("v", F.col("label").alias("_was"), F.least("label", "_low").alias("_low"))
        far = labels.select(F.col("v").alias("_low"), F.col("label").alias("_far"))
        moved = durable(stepped.join(far, "_low", "left").select(
            "v", "_was", F.least("_low", F.coalesce("_far", "_low")).alias("label")))
        labels = moved.select("v", "label")
        if moved.filter("label <> _was").isEmpty():
            return labels


def grouped(rows: DataFrame, tokens: str, vertex: str) -> DataFrame:
    """Each row with the ``component`` of rows that share a token, directly or through others.

    ``tokens``: an array column. A token links its holders with the smallest of them, so a
    token that very many rows hold costs one link for each.
    """
    held = durable(rows.select(vertex, F.explode(tokens).alias("_token")).distinct())
    first = held.groupBy("_token").agg(F.min(vertex).alias("a"))
    found = components(held.join(first, "_token").select("a", F.col(vertex).alias("b")))
    return rows.join(found.select(F.col("v").alias(vertex), F.col("label").alias("component")), vertex, "left").withColumn(
        "component", F.coalesce("component", vertex))

"""Lines of a document with their place and character offset.

A document is at most 8 MiB (S1 rejects the rest), so windows over one document
have a bounded input; every parser below shares this one shuffle by document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.text import split_lines, strip



def doc_order():
    return Window.partitionBy("doc_id").orderBy("pos")


def doc_before():
    return doc_order().rowsBetween(Window.unboundedPreceding, -1)


def doc_so_far():
    return doc_order().rowsBetween(Window.unboundedPreceding, 0)


def whole_doc():
    return Window.partitionBy("doc_id")


def lines(texts: DataFrame, split: Callable[[Column], Column] = split_lines) -> DataFrame:
    """doc_id, pos, raw, start (offset), line (no terminator), stripped; ``split`` says where a line ends."""
    rows = texts.select("doc_id", F.posexplode(split(F.col("text"))).alias("pos", "raw"))
    start = F.coalesce(F.sum(F.char_length("raw")).over(doc_before()), F.lit(0))
    return rows.withColumn("start", start).withColumn(
        "line", F.rtrim("raw", F.lit("\r\n"))).withColumn("stripped", strip(F.col("line")))

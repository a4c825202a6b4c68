"""Scripts written back as Fountain text, which S5 reads as the same units.

A script leaves as ordered parts of bounded size, so no row and no task holds a whole one;
joined in the order of ``part``, the parts are the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import headings as H
from plotline.functions.text import strip
from plotline.operators.scans import Scan

WRITTEN_TRANSITION = r"^[A-Z0-9 .'-]+TO:$"
PART_CHARS = 1 << 16


def heading_line(heading: Column) -> Column:
    text = strip(heading)
    return F.when(H.is_heading(text), text).otherwise(F.concat(F.lit("."), text))


def written_lines(scenes: DataFrame, units: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """script_id, scene_index, place, text: the lines of every scene, each behind what parts it from the one before.

    A blank line parts blocks; a cue and the speech under it are one block.
    """
    kind, text = F.col("unit_type"), F.col("text")
    line = (F.when(kind == "scene_heading", heading_line(text)).when(kind == "character", F.upper(text))
            .when((kind == "parenthetical") & ~text.startswith("("),
                  F.concat(F.lit("("), text, F.lit(")")))
            .when((kind == "transition") & ~text.rlike(WRITTEN_TRANSITION),
                  F.concat(F.lit("> "), text))
            .when(kind == "note", F.concat(F.lit("[["), text, F.lit("]]"))).otherwise(text))
    speech = kind.isin("dialogue", "parenthetical")
    scan = Scan(units.withColumn("line", line), ["script_id", "scene_index"], [F.col("sequence_index")], hot_rows)
    scan.last_seen("_held", F.when(~speech, kind == "character"))
    follows = speech & F.coalesce(F.col("_held"), F.lit(False))
    made = scan.done().filter("line IS NOT NULL").select(
        "script_id", "scene_index", F.col("sequence_index").cast("long").alias("place"),
        F.concat(F.when(follows, F.lit("\n")).otherwise(F.lit("\n\n")), "line").alias("text"))
    opened = units.groupBy("script_id", "scene_index").agg(
        F.min_by("unit_type", "sequence_index").alias("_first"))
    bare = scenes.join(opened, ["script_id", "scene_index"], "left").filter(
        F.col("_first").isNull() | (F.col("_first") != "scene_heading"))
    head = F.coalesce(F.nullif(strip(F.col("heading")), F.lit("")), F.lit("SCENE"))
    extra = bare.select("script_id", "scene_index", F.lit(-2).cast("long").alias("place"),
                        F.concat(F.lit("\n\n"), heading_line(head)).alias("text"))
    omitted = bare.filter("omitted AND _first IS NULL").select(
        "script_id", "scene_index", F.lit(-1).cast("long").alias("place"), F.lit("\n\nOMITTED").alias("text"))
    return made.unionByName(extra).unionByName(omitted)


def export_parts(scripts: DataFrame, scenes: DataFrame, units: DataFrame, part_chars: int = PART_CHARS,
                 hot_rows: int | None = None) -> DataFrame:
    """script_id, part, text: every script in parts of about ``part_chars`` characters, or one longer line."""
    sides = F.array(F.struct(F.lit(0).alias("_side"), F.concat(F.lit("Title: "), F.coalesce("title", F.lit("Untitled"))).alias("text")),
                    F.struct(F.lit(2).alias("_side"), F.lit("\n").alias("text")))
    none = F.lit(None).cast("long")
    ends = scripts.select("script_id", F.explode(sides).alias("e")).select("script_id", "e.*")
    body = written_lines(scenes, units, hot_rows).join(scripts.select("script_id"), "script_id", "left_semi")
    rows = body.withColumn("_side", F.lit(1)).withColumn("scene_index", F.col("scene_index").cast("long")).unionByName(
        ends.withColumns({"scene_index": none, "place": none}))
    order = [F.col(c) for c in ("_side", "scene_index", "place")]
    scan = Scan(rows, ["script_id"], order, hot_rows).total("_offset", F.char_length("text"))
    rows = scan.done().withColumn("part", F.expr(f"_offset div {part_chars}"))
    return rows.groupBy("script_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "_side", "scene_index", "place", "text"))), lambda u: u["text"]), "").alias("text"))


def export_fountain(scripts: DataFrame, scenes: DataFrame, units: DataFrame) -> DataFrame:
    """script_id, text: whole scripts, for readers that take a document as one value."""
    return export_parts(scripts, scenes, units).groupBy("script_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text"))


def write_scripts(parts: DataFrame, folder: str) -> DataFrame:
    """Write the parts as a table, the parts of a script side by side in order, and read it back."""
    parts.repartition("script_id").sortWithinPartitions("script_id", "part").write.mode("overwrite").parquet(folder)
    return parts.sparkSession.read.schema(parts.schema).parquet(folder)

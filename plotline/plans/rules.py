"""The graph that needs no model - cast from cues, the place from the heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import headings as H
from plotline.functions import names
from plotline.functions.text import evaluated
from plotline.operators import quality


def direction_like(text: Column) -> Column:
    """A cue line that is a transition or a camera line after all."""
    return H.is_transition(text) | H.is_shot(text) | text.rlike(H.END_DIRECTION)


def _span(text: Column, name: Column) -> tuple[Column, Column]:
    at = F.when(F.contains(text, name), F.call_function("locate", name, text) - 1)
    return at, at + F.char_length(name)


def provided(units: DataFrame, scenes: DataFrame, ascii_names: bool = False) -> DataFrame:
    """scene_id, entity_type, name, key, predicate, unit and span of each rule fact.

    One row per distinct name in a scene: the first cue that says it, found by a
    combining minimum, so nothing is sorted and no scene is gathered.
    """
    norm = names.normalize_ascii if ascii_names else names.normalize
    cues = evaluated(units.filter("unit_type = 'character'"), "name", H.cue(F.col("text"))["name"])
    cast = cues.select("scene_id", "unit_id", "sequence_index", "text", "name").filter("name IS NOT NULL")
    cast = cast.filter(~direction_like(F.trim("text"))
                       & quality.unusable_name(F.col("name"), F.lit("cast")).isNull())
    cast = evaluated(cast, "key", norm(F.col("name"))).filter("key <> ''")
    first = cast.groupBy("scene_id", "key").agg(
        F.min(F.struct("sequence_index", "unit_id", "text", "name")).alias("f"),
        F.count(F.lit(1)).alias("lines"))
    cast = first.select("scene_id", F.lit("cast").alias("entity_type"), "f.name", "key",
                        F.lit("appears_in").alias("predicate"), "f.unit_id", "f.text", "lines")
    head = units.filter("unit_type = 'scene_heading'").groupBy("scene_id").agg(
        F.min(F.struct("sequence_index", "unit_id", "text")).alias("h"))
    place = H.split_heading(F.col("heading"))["location"]
    sited = evaluated(scenes.join(head, "scene_id"), "name", place).select(
        "scene_id", "h.unit_id", "h.text", "name")
    sited = sited.filter(F.col("name").isNotNull() & ~direction_like(F.trim("name"))
                         & quality.unusable_name(F.col("name"), F.lit("location")).isNull())
    sited = sited.select("scene_id", F.lit("location").alias("entity_type"), "name",
                         norm(F.col("name")).alias("key"), F.lit("occurs_at").alias("predicate"),
                         "unit_id", "text", F.lit(1).cast("long").alias("lines"))
    start, end = _span(F.col("text"), F.col("name"))
    return cast.unionByName(sited).withColumns({
        "start": start, "end": end, "confidence": F.lit(1.0), "provenance": F.lit("system")}).drop("text")

"""Row filters and projections on the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions import names, words
from plotline.functions.text import strip


def active(rows: DataFrame) -> DataFrame:
    return rows.filter("active")


def threshold_counts(edges: DataFrame, keys: list[str], low: float) -> DataFrame:
    """How many edges a confidence threshold shows and hides."""
    return edges.groupBy(*keys).agg(
        F.count_if(F.col("confidence") >= low).alias("shown"),
        F.count_if(F.col("confidence") < low).alias("hidden"))


def typed_ends(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Both endpoint types; AQE broadcasts the type frame only while it is small."""
    subject = types.select(F.col("entity_id").alias("subject_entity_id"),
                           F.col("entity_type").alias("subject_type"))
    obj = types.select(F.col("entity_id").alias("object_entity_id"),
                       F.col("entity_type").alias("object_type"))
    return (edges.join(subject, "subject_entity_id", "left")
            .join(obj, "object_entity_id", "left"))


def in_departments(edges: DataFrame, types: DataFrame, wanted: list[str]) -> DataFrame:
    """Edges with either typed end in a wanted department."""
    return typed_ends(edges, types).filter(
        F.col("subject_type").isin(*wanted) | F.col("object_type").isin(*wanted))


def scene_labels(scenes: DataFrame) -> DataFrame:
    """A printed number, a dash in a numbered script, else the position.

    Whether a script prints numbers is a combined aggregate joined back, so a
    script with very many scenes is never one window group.
    """
    numbered = scenes.groupBy("script_id").agg(
        F.max(F.col("number").isNotNull()).alias("_numbered"))
    label = (F.when(F.col("number").isNotNull(), F.concat(F.lit("Sc "), "number"))
             .when(F.col("_numbered"), "Sc —")
             .otherwise(F.concat(F.lit("Sc "), F.col("sequence_index") + 1)))
    return scenes.join(numbered, "script_id").withColumn("label", label).drop("_numbered")


def node_labels(entities: DataFrame, scenes: DataFrame) -> DataFrame:
    return entities.select(
        F.lit("entity").alias("kind"), F.col("entity_id").alias("node_id"),
        F.col("canonical_name").alias("label"), "entity_type").unionByName(
        scene_labels(scenes).select(
            F.lit("scene").alias("kind"), F.col("scene_id").alias("node_id"), "label",
            F.lit(None).cast("string").alias("entity_type")))


def endpoint(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_entity_id"), F.col(f"{side}_scene_id"))


def with_scene(assertions: DataFrame, units: DataFrame) -> DataFrame:
    """The scene an assertion belongs to; ``units`` has unit_id, scene_id."""
    cited = units.select(F.col("unit_id").alias("source_unit_id"),
                         F.col("scene_id").alias("_unit_scene"))
    return assertions.join(cited, "source_unit_id", "left").withColumn(
        "in_scene", F.coalesce("subject_scene_id", "object_scene_id", "_unit_scene")
    ).drop("_unit_scene")


def library(scripts: DataFrame, view: str) -> DataFrame:
    if view == "needs_review":
        return scripts.filter("import_status = 'needs_review'")
    if view == "recent":
        return scripts.filter("opened_at IS NOT NULL")
    return scripts


def search(rows: DataFrame, cells: list[str], text: str) -> DataFrame:
    """Case-folded substring over all cells of a row."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *cells)), F.lower(F.lit(text))))


def hold_back(operations: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """(kept, held) - additions under the floor leave the change set."""
    held = (F.col("operation_type") == "add_assertion") & (F.col("confidence") < floor)
    if floor <= 0:
        held = F.lit(False)
    held = F.coalesce(held, F.lit(False))
    return operations.filter(~held), operations.filter(held)


def draft_reason(old: Column, new: Column) -> Column:
    """Why a proposed line is refused, or null when it is an edit."""
    before, after = strip(old), strip(new)
    share = words.kept_share(words.spaced(names.fold(before)), words.spaced(names.fold(after)))
    return (F.when(old.isNull(), "missing").when(F.coalesce(after, F.lit("")) == "", "empty")
            .when(before == after, "unchanged")
            .when(share < vocab.DRAFT_KEEP_SHARE, "rewritten"))


def dedupe_key() -> Column:
    """The identity of an edge and its evidence; no part is ever null."""
    parts = [F.col("subject_kind"), endpoint("subject"), F.col("predicate"),
             F.col("object_kind"), endpoint("object"), F.col("source_unit_id")]
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def scene_bodies(scenes: DataFrame, units: DataFrame) -> DataFrame:
    """Each scene in play with its lines in order, headings left out.

    One array per scene is bounded by the 2,000 units a scene may hold.
    """
    body = (units.filter("unit_type <> 'scene_heading'").groupBy("scene_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", "text"))),
                             lambda u: u["text"]).alias("texts")))
    return scenes.filter(~F.col("omitted")).join(body, "scene_id")


def first_in(rows: DataFrame, keys: list[str], order: list[Column], n: int,
             rank: str = "rank") -> DataFrame:
    """Top-n per key. Spark limits each partition before the shuffle, so a hot
    key moves at most n rows per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)

"""A graph seeded from ground-truth tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions import names
from plotline.functions.words import first_endpoint, second_endpoint
from plotline.operators import joins, quality
from plotline.operators.filters import dedupe_key
from plotline.session import durable



def entity_rows(frames: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entities, aliases) the tables state; the first statement of a name fixes its type."""
    stated = frames["entities"].select("doc_id", F.lit(0).alias("part"), "table", "row", "name", "entity_type",
                                       "aliases")
    chained = frames["chains"].select("doc_id", F.lit(1).alias("part"), "table", "row", "name", "entity_type",
                                      F.array().cast("array<string>").alias("aliases"))
    rows = stated.unionByName(chained).withColumn("key", names.normalize(F.col("name"))).filter("key <> ''")
    first = rows.groupBy("doc_id", "key").agg(F.min_by(F.struct("name", "entity_type"), F.struct(
        "part", "table", "row")).alias("e"))
    entities = durable(first.select("doc_id", "key", F.col("e.name").alias("canonical_name"), "e.entity_type",
                            F.sha2(F.concat_ws("|", "doc_id", "e.entity_type", "key"), 256).alias("entity_id")))
    other = rows.withColumn("alias", F.explode("aliases")).withColumn(
        "alias_key", names.normalize(F.col("alias"))).filter("alias_key <> '' AND alias_key <> key")
    aliases = other.groupBy("doc_id", "key", "alias_key").agg(F.min("alias").alias("alias")).join(
        entities.select("doc_id", "key", "entity_id"), ["doc_id", "key"])
    return entities, durable(aliases)


def seed(frames: dict[str, DataFrame], scenes: DataFrame, units: DataFrame,
         existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, assertions, skipped). ``scenes``: doc_id, scene_id, number, heading.

    ``units``: scene_id, unit_id, sequence_index, text, speaker. Seeding twice
    writes nothing: edges whose active key exists are left out.
    """
    entities, aliases = entity_rows(frames)
    surface = entities.select("doc_id", "key", "entity_id", "entity_type").unionByName(
        aliases.join(entities.select("entity_id", "entity_type"), "entity_id").select(
            "doc_id", F.col("alias_key").alias("key"), "entity_id", "entity_type"))
    surface = surface.groupBy("doc_id", "key").agg(F.min(F.struct("entity_id", "entity_type")).alias("s")).select(
        "doc_id", "key", "s.*")
    numbered = scenes.select("doc_id", F.col("number").alias("scene"), "scene_id")

    def edge(predicate, subject, obj, confidence):
        return F.struct(F.lit(predicate).alias("predicate"), subject.alias("s"), obj.alias("o"),
                        F.lit(confidence).alias("confidence"))
    me, here = F.col("entity_id"), F.lit("scene")
    chains = frames["chains"].withColumn("key", names.normalize(F.col("name"))).join(surface.drop("entity_type").join(
        entities.select("entity_id", "entity_type"), "entity_id"), ["doc_id", "key"]).drop(frames["chains"]["entity_type"])
    opening = chains.select("doc_id", "entity_id", F.col("establishes").alias("scene"), F.explode(F.array_compact(F.array(
        edge("establishes", here, me, 0.9),
        F.when(F.col("entity_type") == "cast", edge("appears_in", me, here, 0.9))
        .when(F.col("entity_type") != "location", edge("requires", here, me, 0.9))))).alias("e"))
    later = chains.select("doc_id", "entity_id", F.explode("dependants").alias("scene"), "entity_type").select(
        "doc_id", "entity_id", "scene", F.when(F.col("entity_type") == "location", edge("occurs_at", here, me, 0.9))
        .when(F.col("entity_type") == "cast", edge("appears_in", me, here, 0.88))
        .otherwise(edge("requires", here, me, 0.88)).alias("e"))
    stated = frames["assertions"]

    def named(column):
        return surface.select("doc_id", F.col("key").alias(f"_{column}_key"), F.col("entity_id").alias(f"_{column}"))
    told = stated.withColumn("_subject_key", names.normalize(F.col("subject"))).withColumn(
        "_object_key", names.normalize(F.col("object"))).join(named("subject"), ["doc_id", "_subject_key"], "left").join(
        named("object"), ["doc_id", "_object_key"], "left")
    told = told.select("doc_id", "scene", "predicate", "confidence",
                       F.when(F.col("subject") == "scene", "scene").otherwise(F.col("_subject")).alias("s"),
                       F.when(F.col("object") == "scene", "scene").otherwise(F.col("_object")).alias("o"))
    spoken = units.filter("speaker IS NOT NULL").select("scene_id", names.normalize(F.col("speaker")).alias("key")
                                                        ).distinct().join(scenes.select("scene_id", "doc_id", "number"),
                                                                          "scene_id")
    appears = spoken.join(surface.filter("entity_type = 'cast'"), ["doc_id", "key"]).select(
        "doc_id", F.col("number").alias("scene"), F.lit("appears_in").alias("predicate"), me.alias("s"), here.alias("o"),
        F.lit(0.9).alias("confidence"))
    places = entities.filter("entity_type = 'location'").select(
        F.col("doc_id").alias("script_id"), F.col("entity_id").alias("name_id"), F.col("key").alias("name"))
    heads = scenes.select(F.col("doc_id").alias("script_id"), F.col("scene_id").alias("text_id"),
                          names.normalize(F.coalesce("heading", F.lit(""))).alias("text"))
    sited = joins.longest_name(heads, places).join(places, ["script_id", "name"]).join(
        scenes.select(F.col("scene_id").alias("text_id"), F.col("number").alias("scene")), "text_id").select(
        F.col("script_id").alias("doc_id"), "scene", F.lit("occurs_at").alias("predicate"), here.alias("s"),
        F.col("name_id").alias("o"), F.lit(0.9).alias("confidence"))
    flat = [f.select("doc_id", "scene", "e.*") for f in (opening, later)]
    wanted = flat[0].unionByName(flat[1]).unionByName(told).unionByName(appears).unionByName(sited)
    return (entities, *_placed(wanted.join(numbered, ["doc_id", "scene"]), entities, aliases, units, existing))


def _placed(wanted, entities, aliases, units, existing):
    """Validate the edges, cite a line for each, and leave out what is there."""
    types = entities.select("entity_id", "entity_type")

    def typed(frame, side):
        t = types.select(F.col("entity_id").alias(side), F.col("entity_type").alias(f"{side}_type"))
        return frame.join(t, side, "left")
    rows = typed(typed(wanted, "s"), "o").withColumns({
        "subject_kind": F.when(F.col("s") == "scene", "scene").otherwise("entity"),
        "object_kind": F.when(F.col("o") == "scene", "scene").otherwise("entity")})
    reason = F.when(F.col("s").isNull() | F.col("o").isNull(), "unresolved_endpoint").otherwise(
        quality.signature_reason(subject_type="s_type", object_type="o_type"))
    rows = durable(rows.withColumn("reason", reason))
    good = rows.filter("reason IS NULL").withColumn("entity_id", F.when(
        F.col("subject_kind") == "entity", F.col("s")).otherwise(F.col("o")))
    last = F.element_at(F.split("canonical_name", r"\s+"), -1)
    own = entities.select("entity_id", F.explode(F.array_compact(F.array(
        "canonical_name", F.when(F.char_length(last) > 4, last)))).alias("needle"))
    needles = own.unionByName(aliases.select("entity_id", F.col("alias").alias("needle"))).distinct()
    pairs = good.select("scene_id", "entity_id").distinct().join(needles, "entity_id")
    cited = joins.first_mention(pairs, units)
    located = durable(good.join(cited, ["scene_id", "entity_id"], "left"))
    unplaced = located.filter("unit_id IS NULL").select("doc_id", F.lit("no_unit").alias("reason"))
    p = F.col("predicate")
    located = located.filter("unit_id IS NOT NULL").withColumns({
        "_a": first_endpoint(p, F.col("s"), F.col("o")), "_b": second_endpoint(p, F.col("s"), F.col("o"))})

    def end(kind, column, wanted_kind, scene=False):
        return F.when(F.col(kind) == wanted_kind, F.col("scene_id").cast("string") if scene else F.col(column))
    located = located.withColumns({
        "script_id": F.col("doc_id"), "source_unit_id": F.col("unit_id"),
        "subject_entity_id": end("subject_kind", "_a", "entity"),
        "subject_scene_id": end("subject_kind", "_a", "scene", True),
        "object_entity_id": end("object_kind", "_b", "entity"),
        "object_scene_id": end("object_kind", "_b", "scene", True)}).withColumn("dedupe_key", dedupe_key())
    once = located.groupBy("script_id", "dedupe_key").agg(F.max_by(F.struct(
        "subject_kind", "subject_entity_id", "subject_scene_id", "predicate", "object_kind", "object_entity_id",
        "object_scene_id", "source_unit_id", "start", "end", "confidence"), "confidence").alias("e")).select(
        "script_id", "dedupe_key", "e.*").withColumn(
        "manner", F.when(F.col("predicate") == "appears_in", "on_stage"))
    if existing is not None:
        once = once.join(existing.filter("active").select("script_id", "dedupe_key"),
                         ["script_id", "dedupe_key"], "left_anti")
    skipped = rows.filter("reason IS NOT NULL").select("doc_id", "reason").unionByName(unplaced)
    return once, skipped



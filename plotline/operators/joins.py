"""Join shapes over the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline import vocab
from plotline.operators import mentions, scans
from plotline.operators.filters import endpoint
from plotline.session import durable


def findings(t) -> DataFrame:
    """Findings of the star schema: one per order."""
    return t.orders.select(
        F.col("o_orderkey").alias("finding_id"), F.col("o_custkey").alias("script_id"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' "
               "ELSE 'low' END").alias("severity"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'dismissed' "
               "ELSE 'open' END").alias("status"))


def earliest_place(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each finding with the first (scene, unit) it cites; null when it cites none.

    The minimum is taken per finding before the join, so evidence shuffles once
    and already combined.
    """
    first = evidence.groupBy("finding_id").agg(
        F.min(F.struct("scene_index", "unit_index")).alias("_place"))
    return found.join(first, "finding_id", "left").select(
        *found.columns, "_place.scene_index", "_place.unit_index")


def ranked_places(placed: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """Position in script order, findings with no line last."""
    placed = durable(placed)
    order = [F.col("scene_index").asc_nulls_last(), F.col("unit_index").asc_nulls_last(),
             F.col("finding_id")]
    return scans.ordinal(placed, keys, order, "position", hot_rows)


def endpoint_frame(assertions: DataFrame) -> DataFrame:
    """One row per (assertion, entity) it touches; both sides the same counts once.

    Joining this frame replaces an OR condition, which would plan as a nested
    loop. The two ends are told apart per row, so no shuffle removes duplicates.
    """
    ends = F.array_distinct(F.array_compact(F.array("subject_entity_id", "object_entity_id")))
    return assertions.select("assertion_id", F.explode(ends).alias("entity_id"))


def by_identity(accepted: DataFrame, proposed: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join; ``state`` is removed, added or unchanged."""
    a = accepted.withColumn("_a", F.lit(True))
    b = proposed.withColumn("_b", F.lit(True))
    state = (F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added")
             .otherwise("unchanged"))
    return a.join(b, key, "full_outer").withColumn("state", state).drop("_a", "_b")


def not_only_stopwords(named: DataFrame) -> DataFrame:
    """A name made only of stopwords scopes nothing."""
    return named.filter(F.exists("name_words", lambda w: ~w.isin(*vocab.STOPWORDS)))


def labelled(assertions: DataFrame, labels: DataFrame) -> DataFrame:
    """Both endpoint labels by (kind, node)."""
    def side(name):
        return labels.select(F.col("kind").alias(f"{name}_kind"),
                             F.col("node_id").alias(f"{name}_key"),
                             F.col("label").alias(f"{name}_label"))
    keyed = assertions.withColumn("subject_key", endpoint("subject")).withColumn(
        "object_key", endpoint("object"))
    return (keyed.join(side("subject"), ["subject_kind", "subject_key"], "left")
            .join(side("object"), ["object_kind", "object_key"], "left"))


def lineage(new: DataFrame, old: DataFrame, old_aliases: DataFrame,
            alias_key: str = "alias_key") -> DataFrame:
    """The predecessor of each entity by link, then by name, then by alias.

    ``old_aliases``: entity_id, entity_type, normalized_alias. An alias shared by
    several entities resolves to the lowest id. ``how`` says which rule matched.
    """
    keys = ["entity_type"]
    if "script_pair" in new.columns:
        keys = ["script_pair", "entity_type"]
    by_name = old.select(*keys, "normalized_name", F.col("entity_id").alias("_by_name"))
    by_alias = old_aliases.groupBy(*keys, F.col("normalized_alias").alias(alias_key)).agg(
        F.min("entity_id").alias("_by_alias"))
    joined = (new.join(by_name, [*keys, "normalized_name"], "left")
              .join(by_alias, [*keys, alias_key], "left"))
    how = (F.when(F.col("predecessor_entity_id").isNotNull(), "link")
           .when(F.col("_by_name").isNotNull(), "name")
           .when(F.col("_by_alias").isNotNull(), "alias").otherwise("added"))
    return joined.withColumn("how", how).withColumn(
        "source_id", F.coalesce("predecessor_entity_id", "_by_name", "_by_alias")
    ).drop("_by_name", "_by_alias")


def zip_units(pairs: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The k-th unit of one scene with the k-th of the other.

    Returns (zipped, uneven pairs). A scene holds at most 2,000 units, so the
    window groups are bounded.
    """
    window = Window.partitionBy("scene_id").orderBy("sequence_index")
    size = units.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"))
    placed = units.select("scene_id", "unit_id", F.row_number().over(window).alias("_k"))
    sizes = [size.select(F.col("scene_id").alias(f"{s}_scene_id"), F.col("_n").alias(f"_{s}_n"))
             for s in ("old", "new")]
    sized = pairs.join(sizes[0], "old_scene_id", "left").join(sizes[1], "new_scene_id", "left")
    even = sized.filter(F.col("_old_n") == F.col("_new_n")).drop("_old_n", "_new_n")
    old = placed.select(F.col("scene_id").alias("old_scene_id"), F.col("unit_id").alias("old_unit_id"),
                        "_k")
    new = placed.select(F.col("scene_id").alias("new_scene_id"), F.col("unit_id").alias("new_unit_id"),
                        "_k")
    zipped = even.join(old, "old_scene_id").join(new, ["new_scene_id", "_k"])
    uneven = sized.filter(~F.col("_old_n").eqNullSafe(F.col("_new_n"))).drop("_old_n", "_new_n")
    return zipped, uneven


def last_before(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, row_id: str,
                mark_id: str, hot_rows: int | None = None) -> DataFrame:
    """Each row with the last mark of its key at or before it.

    Both sides become one ordered frame; a mark precedes a row of equal place.
    """
    both = marks.select(*keys, at, F.lit(0).alias("_side"), F.col(mark_id),
                        F.lit(None).cast(rows.schema[row_id].dataType).alias(row_id)).unionByName(
        rows.select(*keys, at, F.lit(1).alias("_side"), row_id,
                    F.lit(None).cast(marks.schema[mark_id].dataType).alias(mark_id)))
    placed = F.when(F.col("_side") == 0, F.struct(at, mark_id))
    scan = scans.Scan(both.withColumn("_placed", placed), keys, [F.col(at), F.col("_side")], hot_rows)
    scan.carry({"_before": (F.max("_placed"), F.max)})
    inside = F.max("_placed").over(scan.window().rowsBetween(Window.unboundedPreceding, 0))
    found = scan.add({"_found": F.coalesce(inside, F.col("_before"))}).done("_placed", "_before", mark_id)
    return found.filter("_side = 1").withColumn(mark_id, F.col(f"_found.{mark_id}")).drop("_side", "_found")


def longest_name(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The longest place name each heading holds; ties go to the greater name."""
    hits = mentions.substring_hits(texts, places, ["script_id"])
    return hits.groupBy("script_id", "text_id").agg(
        F.max_by("name", F.struct(F.char_length("name"), "name")).alias("name"))


def first_mention(wanted: DataFrame, units: DataFrame) -> DataFrame:
    """The first unit of a scene that names an entity, longest needle first.

    ``wanted``: scene_id, entity_id, needle. Both sides meet inside one scene,
    which holds at most 2,000 units; only real hits leave the join. Where none
    names the entity the scene's first unit is cited with no span.
    """
    low = F.lower("needle")
    hits = units.join(wanted.withColumn("_low", low), "scene_id").filter(
        F.contains(F.lower("text"), F.col("_low")))
    at = F.expr("locate(_low, lower(text))")
    best = hits.groupBy("scene_id", "entity_id").agg(F.min(F.struct(
        "sequence_index", (-F.char_length("needle")).alias("_len"), "needle", "unit_id",
        (at - 1).alias("start"))).alias("_hit"))
    first = units.groupBy("scene_id").agg(F.min_by("unit_id", "sequence_index").alias("_first"))
    asked = wanted.select("scene_id", "entity_id").distinct()
    return (asked.join(first, "scene_id").join(best, ["scene_id", "entity_id"], "left").select(
        "scene_id", "entity_id", F.coalesce("_hit.unit_id", "_first").alias("unit_id"),
        F.col("_hit.start").alias("start"),
        (F.col("_hit.start") + F.char_length("_hit.needle")).alias("end")))


def cover_plan(planned: DataFrame, covered: DataFrame, key: list[str]) -> DataFrame:
    """A plan row for every covered scene; what it leaves out is stated as such."""
    rows = planned.withColumn("_stated", F.lit(True)).join(covered, key, "full_outer")
    return rows.select(
        *key, F.coalesce("change", F.lit("No change planned.")).alias("change"),
        F.coalesce("_stated", F.lit(False)).alias("needs"),
        F.coalesce("citation", F.lit("")).alias("citation"))


def excluding(rows: DataFrame, barred: DataFrame, key: str) -> DataFrame:
    """An anti join, which keeps rows whose key is null."""
    return rows.join(barred.select(key).distinct(), key, "left_anti")


def all_surfaces(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every name and alias, with the side it came from."""
    return entities.select("entity_id", F.lit("name").alias("side"),
                           F.col("canonical_name").alias("name")).unionByName(
        aliases.select("entity_id", F.lit("alias").alias("side"), F.col("alias").alias("name")))

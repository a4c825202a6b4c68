"""Merging entities, resolving mentions, renames between drafts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions.phrases import draft_rename_message
from plotline.functions.words import spaced
from plotline.operators.filters import dedupe_key
from plotline.operators.links import components, grouped
from plotline.session import durable


def refused_merges(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs that may not merge, with the reason. ``pairs``: position, keep_id, absorb_id."""
    def side(s):
        return entities.select(F.col("entity_id").alias(f"{s}_id"), F.col("script_id").alias(f"_{s}_script"),
                               F.col("entity_type").alias(f"_{s}_type"))
    rows = pairs.join(side("keep"), "keep_id", "left").join(side("absorb"), "absorb_id", "left")
    missing = F.col("_keep_script").isNull() | F.col("_absorb_script").isNull()
    reason = (F.when(missing, "no_such_entity").when(F.col("keep_id") == F.col("absorb_id"), "itself")
              .when(F.col("_keep_script") != F.col("_absorb_script"), "other_script")
              .when(F.col("_keep_type") != F.col("_absorb_type"), "other_type"))
    return rows.withColumn("refused", reason).select(*pairs.columns, "refused")


def folded(rows: pd.DataFrame) -> pd.DataFrame:
    """One conflict component in the order of its pairs: applied, or skipped by the pair that absorbed a side before."""
    absorbed: dict = {}
    by = []
    for pair in rows.sort_values("position").itertuples(index=False):
        earlier = [absorbed[x] for x in (pair.keep_id, pair.absorb_id) if x in absorbed]
        by.append((pair.position, min(earlier) if earlier else None))
        if not earlier:
            absorbed[pair.absorb_id] = pair.position
    return pd.DataFrame(by, columns=["position", "skipped_by"]).astype({"skipped_by": "Int64"})


def merge_record(pairs: DataFrame) -> DataFrame:
    """Every pair of a batch with ``skipped_by``, the pair that absorbed one of its sides before; null if applied.

    ``pairs``: position (unique), keep_id, absorb_id. A pair no earlier pair could forbid is
    applied, and one whose first such rival is applied is skipped by it: that settles most
    without a fold. If any are left, pairs that share entities, directly or through others,
    form components, and each is folded once in the order of its pairs.
    """
    takes = pairs.groupBy(F.col("absorb_id").alias("x")).agg(F.min("position").alias("p"))
    ends = pairs.select("position", F.explode(F.array_distinct(F.array("keep_id", "absorb_id"))).alias("x"))
    rival = ends.join(takes, "x").filter(F.col("p") < F.col("position")).groupBy("position").agg(F.min("p").alias("skipped_by"))
    first = durable(pairs.join(rival, "position", "left"))
    sure = first.filter("skipped_by IS NULL").select(F.col("position").alias("skipped_by"))
    if first.filter("skipped_by IS NOT NULL").join(sure, "skipped_by", "left_anti").isEmpty():
        return first
    links = components(pairs.select(F.col("keep_id").alias("a"), F.col("absorb_id").alias("b")))
    rows = durable(pairs.join(links.withColumnRenamed("v", "keep_id"), "keep_id"))
    several = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("label")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    settled = rows.join(several, "label", "left_semi").select("label", "position", "keep_id", "absorb_id").groupBy("label").applyInPandas(
        folded, f"position {kinds['position']}, skipped_by {kinds['position']}")
    return pairs.join(settled, "position", "left")


def in_force(pairs: DataFrame) -> DataFrame:
    """The pairs a batch applies: one is skipped when an earlier applied pair absorbed either side."""
    return merge_record(pairs).filter("skipped_by IS NULL").select(*pairs.columns)


def roots(applied: DataFrame) -> DataFrame:
    """Where each absorbed entity ends up: chains followed by doubling the step.

    A loop of absorptions, which ``in_force`` never makes, would have no end: it raises.
    """
    links = durable(applied.select(F.col("absorb_id").alias("entity_id"), F.col("keep_id").alias("root_id"),
                                   "position"))
    reach, most = 1, links.count()
    while reach <= 2 * most:
        up = links.select(F.col("entity_id").alias("root_id"), F.col("root_id").alias("_up"))
        stepped = durable(links.join(up, "root_id", "left"))
        if stepped.filter("_up IS NOT NULL").isEmpty():
            return links
        links = stepped.select("entity_id", F.coalesce("_up", "root_id").alias("root_id"), "position")
        reach *= 2
    if not most:
        return links
    raise ValueError("the absorptions form a loop")


def _moved(frame: DataFrame, column: str, root: DataFrame) -> DataFrame:
    r = root.select(F.col("entity_id").alias(column), F.col("root_id").alias("_root"))
    return frame.join(r, column, "left").withColumn(
        f"_was_{column}", F.col(column)).withColumn(column, F.coalesce("_root", column)).drop("_root")


def merge(tables: dict[str, DataFrame], root: DataFrame) -> dict[str, DataFrame]:
    """Every table after the absorptions in ``root`` (entity_id, root_id, position).

    An edge whose new key another row already holds is dropped; a colliding
    active attribute is deactivated, the survivor's own first; the absorbed names
    become aliases.
    """
    facts = _moved(_moved(tables["assertions"], "subject_entity_id", root), "object_entity_id", root)
    shifted = ~(F.col("_was_subject_entity_id").eqNullSafe(F.col("subject_entity_id"))
                & F.col("_was_object_entity_id").eqNullSafe(F.col("object_entity_id")))
    facts = facts.withColumn("dedupe_key", dedupe_key()).withColumn("_m", shifted).drop(
        "_was_subject_entity_id", "_was_object_entity_id")
    still = facts.filter("NOT _m").drop("_m")
    moving = facts.filter("_m").drop("_m").join(
        still.select("script_id", "dedupe_key"), ["script_id", "dedupe_key"], "left_anti")
    first = moving.groupBy("script_id", "dedupe_key").agg(F.min("assertion_id").alias("assertion_id"))
    out = {"assertions": still.unionByName(moving.join(first.select("assertion_id"), "assertion_id", "left_semi"))}
    if "attributes" in tables:
        a = _moved(tables["attributes"], "entity_id", root)
        own = F.col("_was_entity_id") != F.col("entity_id")
        place = F.struct(own.alias("moved"), "attribute_id")
        best = a.filter("active").groupBy("entity_id", "key").agg(F.min(place).alias("_best"))
        out["attributes"] = a.join(best, ["entity_id", "key"], "left").withColumn(
            "active", F.col("active") & (F.col("attribute_id") == F.col("_best.attribute_id"))
        ).drop("_best", "_was_entity_id")
    entities = tables["entities"]
    out["entities"] = entities.join(root.select("entity_id"), "entity_id", "left_anti")
    named = entities.join(root, "entity_id").select(
        F.col("root_id").alias("entity_id"), F.col("canonical_name").alias("alias"),
        F.col("normalized_name").alias("normalized_alias"))
    surfaces = _moved(tables["aliases"], "entity_id", root).select("entity_id", "alias", "normalized_alias")
    surfaces = surfaces.unionByName(named).groupBy("entity_id", "normalized_alias").agg(F.min("alias").alias("alias"))
    own_name = entities.select("entity_id", F.col("normalized_name").alias("normalized_alias"))
    out["aliases"] = surfaces.join(own_name, ["entity_id", "normalized_alias"], "left_anti")
    if "units" in tables:
        out["units"] = _moved(tables["units"], "speaker_entity_id", root).drop("_was_speaker_entity_id")
    return out


def one_holder(rows: DataFrame, key: list[str], holder: str) -> DataFrame:
    """Keys exactly one entity holds; an ambiguous name resolves to nobody."""
    return rows.groupBy(*key).agg(F.min(holder).alias("holder"), F.max(holder).alias("_other")).filter(
        F.col("holder") == F.col("_other")).drop("_other")


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each mention against the graph as it stands: name, alias, cast extension, or new.

    ``mentions``: script_id, entity_type, normalized_name (distinct names are
    resolved once). A cast name extends another when one word list is a proper
    prefix of the other; that is an equi join on prefixes, not a pair scan.
    """
    scope = ["script_id", "entity_type"]
    key = [*scope, "normalized_name"]
    asked = mentions.select(*key).distinct()
    by_name = entities.select(*key, F.col("entity_id").alias("_name"))
    held = one_holder(aliases.join(entities.select("entity_id", *scope), "entity_id").withColumnRenamed(
        "normalized_alias", "normalized_name"), key, "entity_id").withColumnRenamed("holder", "_alias")

    def prefixes(words: Column) -> Column:
        return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n:
                      F.array_join(F.slice(words, F.lit(1), n), " "))).otherwise(F.array().cast("array<string>"))
    cast = F.col("entity_type") == "cast"
    people, wanted = entities.filter(cast), asked.filter(cast)
    longer = people.select(*scope, "entity_id", F.explode(prefixes(spaced(F.col("normalized_name"))))
                           .alias("normalized_name")).join(wanted, key)
    shorter = wanted.withColumn("_p", F.explode(prefixes(spaced(F.col("normalized_name"))))).join(
        people.select(*scope, "entity_id", F.col("normalized_name").alias("_p")), [*scope, "_p"])
    related = longer.select(*key, "entity_id").unionByName(shorter.select(*key, "entity_id"))
    extended = one_holder(related, key, "entity_id").withColumnRenamed("holder", "_ext")
    found = asked.join(by_name, key, "left").join(held, key, "left").join(extended, key, "left")
    how = (F.when(F.col("_name").isNotNull(), "name").when(F.col("_alias").isNotNull(), "alias")
           .when(F.col("_ext").isNotNull(), "extension").otherwise("new"))
    return found.withColumn("how", how).withColumn("entity_id", F.coalesce("_name", "_alias", "_ext")).drop(
        "_name", "_alias", "_ext")


def resolve_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Strict form of G13 for names that may match each other: a mention may match one made before it.

    ``rows``: position, normalized_name, known (an entity that exists), aliases.
    """
    is_cast = (rows["entity_type"] == "cast").iloc[0]
    by_name, by_alias, heads, out = {}, {}, {}, []
    for row in rows.sort_values("position").itertuples(index=False):
        name, words = row.normalized_name, row.normalized_name.split()
        target, how = (name, "name") if name in by_name else (None, "new")
        if not row.known and target is None:
            holders = by_alias.get(name, set())
            if len(holders) == 1:
                target, how = next(iter(holders)), "alias"
            elif is_cast and words:
                near = [n for n in heads.get(words[0], ()) if n != name
                        and n.split()[:len(words)] == words[:len(n.split())]
                        and len(n.split()) != len(words)]
                if len(near) == 1:
                    target, how = near[0], "extension"
        if target is None:
            target, how = name, "known" if row.known else "new"
            by_name[name] = target
            if words:
                heads.setdefault(words[0], []).append(name)
        for alias in [*row.aliases, name]:
            if alias and alias != target:
                by_alias.setdefault(alias, set()).add(target)
        if not row.known:
            out.append((row.position, name, target, how))
    frame = pd.DataFrame(out, columns=["position", "normalized_name", "target_name", "how"])
    return frame.assign(script_id=rows["script_id"].iloc[0], entity_type=rows["entity_type"].iloc[0])


def resolve_strictly(entities: DataFrame, aliases: DataFrame, mentions: DataFrame) -> DataFrame:
    """G13 with the order of mentions honoured.

    A mention can only match a name it shares a surface (a name or alias) with or, for cast,
    the first word. Names that share none of these, even through others, are apart: each such
    component is resolved on its own, in order. Mentions are first cut to the first of each name.
    """
    scope = ["script_id", "entity_type"]
    none = F.array().cast("array<string>")
    held = aliases.groupBy("entity_id").agg(F.collect_set("normalized_alias").alias("aliases"))
    known = entities.join(held, "entity_id", "left").select(
        *scope, F.lit(-1).cast("long").alias("position"), "normalized_name", F.lit(True).alias("known"),
        F.coalesce("aliases", none).alias("aliases"))
    said = mentions.withColumn("_a", F.explode_outer("aliases")).groupBy(*scope, "normalized_name").agg(
        F.min("position").alias("position"), F.collect_set("_a").alias("aliases")).select(
        *scope, "position", "normalized_name", F.lit(False).alias("known"), "aliases")
    rows = known.unionByName(said)
    word = F.when(F.col("entity_type") == "cast", F.concat(F.lit("w"), F.element_at(F.split("normalized_name", " "), 1)))
    surfaces = F.transform(F.concat(F.array("normalized_name"), "aliases"), lambda x: F.concat(F.lit("s"), x))
    tokens = F.transform(F.array_compact(F.concat(surfaces, F.array(word))), lambda x: F.xxhash64(*scope, x))
    rows = durable(rows.withColumns({"_tokens": tokens, "_vertex": F.xxhash64(*scope, "normalized_name")}))
    kind = entities.schema["script_id"].dataType.simpleString()
    return grouped(rows, "_tokens", "_vertex").drop("_tokens", "_vertex").groupBy(*scope, "component").applyInPandas(
        resolve_in_order, "position long, normalized_name string, target_name string, how string, "
                          f"script_id {kind}, entity_type string")


def names_of(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entity_id, name: canonical key, given name, and aliases."""
    given = F.element_at(F.split("normalized_name", " "), 1)
    return entities.select("entity_id", F.explode(F.array("normalized_name", given)).alias("name")).unionByName(
        aliases.select("entity_id", F.col("normalized_alias").alias("name"))).filter("name <> ''").distinct()


def detect_renames(new_units: DataFrame, old_units: DataFrame, added: DataFrame, added_names: DataFrame,
                   old_cast: DataFrame, old_names: DataFrame) -> DataFrame:
    """Cast a draft seems to have renamed, by speaking positions that changed hands.

    ``new_units``: script_id, unit_id, predecessor_unit_id, speaker (normalized).
    ``old_units``: unit_id, old_script_id, speaker. ``added``/``old_cast``: script
    and name of the entities; ``*_names``: entity_id, name. Positions are counted
    per (new, old) pair and the largest wins.
    """
    lineage = new_units.filter("predecessor_unit_id IS NOT NULL AND speaker IS NOT NULL").select(
        "script_id", F.col("predecessor_unit_id").alias("unit_id"), F.col("speaker").alias("now"))
    carried = lineage.join(old_units.filter("speaker IS NOT NULL").select(
        "unit_id", "old_script_id", F.col("speaker").alias("was")), "unit_id")
    speakers = old_cast.join(old_names, "entity_id").groupBy("old_script_id", F.col("name").alias("was")).agg(
        F.min("entity_id").alias("old_entity_id"))
    counted = carried.groupBy("script_id", "old_script_id", "now", "was").agg(F.count(F.lit(1)).alias("n"))
    known = counted.join(speakers, ["old_script_id", "was"])
    mapped = known.groupBy("script_id", "old_entity_id").agg(F.sum("n").alias("total_mapped"))
    joined = added.select("script_id", F.col("entity_id").alias("new_entity_id"), F.col("canonical_name").alias(
        "new_name")).join(added_names.select(F.col("entity_id").alias("new_entity_id"), F.col("name").alias("now")),
                          "new_entity_id").join(known, ["script_id", "now"])
    own = added_names.select(F.col("entity_id").alias("new_entity_id"), F.col("name").alias("_own"))
    old = old_cast.select(F.col("entity_id").alias("old_entity_id"), F.col("canonical_name").alias("old_name"),
                          F.col("normalized_name").alias("_own"))
    moved = joined.join(old, "old_entity_id").join(own, ["new_entity_id", "_own"], "left_anti").groupBy(
        "script_id", "new_entity_id", "new_name", "old_entity_id", "old_name").agg(F.sum("n").alias("transferred"))
    best = moved.groupBy("script_id", "new_entity_id", "new_name").agg(F.max_by(
        F.struct("old_entity_id", "old_name", "transferred"),
        F.struct("transferred", (-F.col("old_entity_id")).alias("_low"))).alias("b")).select(
        "script_id", "new_entity_id", "new_name", "b.*")
    scored = best.join(mapped, ["script_id", "old_entity_id"]).withColumn(
        "share", F.col("transferred") / F.col("total_mapped"))
    automatic = (F.col("transferred") >= vocab.RENAME_MIN_POSITIONS) & (F.col("share") >= vocab.RENAME_AUTO_SHARE)
    return scored.filter(F.col("share") >= vocab.RENAME_SUGGEST_SHARE).withColumns({
        "automatic": automatic, "message": draft_rename_message(
            F.col("old_name"), F.col("new_name"), F.col("transferred"), F.col("total_mapped"))})


def rename_roots(renames: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(absorptions, links). A carried twin survives and takes the new name.

    ``renames``: script_id, old_entity_id, new_entity_id, new_name.
    """
    twin = entities.filter("predecessor_entity_id IS NOT NULL").groupBy(
        "script_id", F.col("predecessor_entity_id").alias("old_entity_id")).agg(F.min("entity_id").alias("twin_id"))
    rows = renames.join(twin, ["script_id", "old_entity_id"], "left")
    twinned = rows.filter((F.col("twin_id").isNotNull()) & (F.col("twin_id") != F.col("new_entity_id")))
    absorbed = twinned.select(F.col("new_entity_id").alias("entity_id"), F.col("twin_id").alias("root_id"),
                              F.col("new_entity_id").alias("position"), "new_name")
    linked = rows.filter(F.col("twin_id").isNull()).select(
        F.col("new_entity_id").alias("entity_id"), F.col("old_entity_id").alias("predecessor_entity_id"))
    return absorbed, linked


def leftovers(survivors: DataFrame, aliases: DataFrame, cues: DataFrame) -> DataFrame:
    """Cues still under a name the entity no longer goes by.

    ``survivors``: script_id, entity_id, normalized_name. ``cues``: script_id,
    unit_id, speaker (normalized).
    """
    given = F.element_at(F.split("normalized_alias", " "), 1)
    old = aliases.select("entity_id", F.explode(F.array("normalized_alias", given)).alias("name")).distinct()
    current = survivors.select("entity_id", F.explode(F.array(
        F.col("normalized_name"), F.element_at(F.split("normalized_name", " "), 1))).alias("name"))
    stale = old.join(current, ["entity_id", "name"], "left_anti").filter("name <> ''")
    return survivors.select("script_id", "entity_id").join(stale, "entity_id").join(
        cues.withColumnRenamed("speaker", "name"), ["script_id", "name"])

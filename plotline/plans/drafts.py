"""Aligning drafts and carrying the graph across."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions import similarity
from plotline.functions.names import caseless
from plotline.functions.text import strip
from plotline.operators import joins
from plotline.operators.joins import endpoint_frame
from plotline.operators.scans import Scan
from plotline.session import durable

PAIR = "pair_id"


def content_key(heading: Column, texts: Column) -> Column:
    """Equal exactly when heading and stripped lines are equal."""
    return F.sha2(F.to_json(F.struct(strip(caseless(heading)).alias("h"),
                                     F.transform(texts, strip).alias("t"))), 256)


def is_omitted_marker(heading: Column) -> Column:
    return F.upper(strip(heading)).isin(*vocab.OMITTED_HEADINGS)


def _kth(frame: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The k-th row of each key; a draft holds at most 400 scenes."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def exact_passes(old: DataFrame, new: DataFrame, confirmed: DataFrame | None = None
                 ) -> dict[str, DataFrame]:
    """Confirmed pairs, identical content k-th to k-th, then locked numbers.

    ``old``/``new``: pair_id (of drafts), scene_id, position, number, heading,
    texts. Returns pairs, deleted (by OMITTED placeholders), and what is left on
    each side.
    """
    def keyed(frame):
        return durable(frame.withColumns({"key": content_key(F.col("heading"), F.col("texts")),
                                          "marker": is_omitted_marker(F.col("heading"))}))
    o, n = keyed(old), keyed(new)
    pairs = None
    o_left, n_left = o, n
    if confirmed is not None:
        c = confirmed.join(o.select(PAIR, F.col("scene_id").alias("old_id")), [PAIR, "old_id"], "left_semi").join(
            n.select(PAIR, F.col("scene_id").alias("new_id")), [PAIR, "new_id"], "left_semi")
        c = _kth(_kth(c, [PAIR, "old_id"], "new_id", "_a"), [PAIR, "new_id"], "old_id", "_b").filter(
            "_a = 1 AND _b = 1")
        pairs = c.select(PAIR, "old_id", "new_id", F.lit("modified").alias("kind"), F.lit("confirmed").alias("method"))
        o_left, n_left = _without(o, pairs, "old_id"), _without(n, pairs, "new_id")
    a = _kth(o_left, [PAIR, "key"], "position", "k")
    b = _kth(n_left.filter(~F.col("marker")), [PAIR, "key"], "position", "k")
    same = durable(a.select(PAIR, "key", "k", F.col("scene_id").alias("old_id")).join(
        b.select(PAIR, "key", "k", F.col("scene_id").alias("new_id")), [PAIR, "key", "k"]).select(
        PAIR, "old_id", "new_id", F.lit("unchanged").alias("kind"), F.lit("content").alias("method")))
    pairs = same if pairs is None else pairs.unionByName(same)
    o_left, n_left = _without(o_left, same, "old_id"), _without(n_left, same, "new_id")
    # Locked numbers speak only when both drafts print numbers; a repeated number means its last scene.
    numbered = F.coalesce("number", F.lit("")) != ""
    both = o.filter(numbered).select(PAIR).distinct().join(n.filter(numbered).select(PAIR).distinct(), PAIR)
    by_number = o_left.filter(numbered).join(both, PAIR).groupBy(PAIR, "number").agg(
        F.max_by(F.struct("scene_id", "key"), "position").alias("o"))
    first = n_left.filter(numbered).join(both, PAIR).groupBy(PAIR, "number").agg(
        F.min_by(F.struct("scene_id", "key", "marker"), "position").alias("n"))
    hits = durable(by_number.join(first, [PAIR, "number"]).select(
        PAIR, F.col("o.scene_id").alias("old_id"), F.col("n.scene_id").alias("new_id"), F.col("n.marker").alias("marker"),
        F.when(F.col("o.key") == F.col("n.key"), "unchanged").otherwise("modified").alias("kind")))
    deleted = hits.filter("marker").select(PAIR, F.col("old_id"))
    locked = hits.filter("NOT marker").select(PAIR, "old_id", "new_id", "kind", F.lit("number").alias("method"))
    return {"pairs": pairs.unionByName(locked), "deleted": deleted,
            "old_left": _without(o_left, hits, "old_id"),
            "new_left": _without(n_left.filter(~F.col("marker")), hits, "new_id")}


def _without(frame: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    used = pairs.select(PAIR, F.col(side).alias("scene_id"))
    return frame.join(used, [PAIR, "scene_id"], "left_anti")


def best_chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The heaviest chain of links that rises in both drafts.

    ``rows`` holds the scored links of one draft pair (old rank i, new rank j). Links
    are visited by rising i; a prefix-maximum tree over the new ranks in use answers
    which chain ending further left weighs most, so k links cost k log k. Of chains of
    equal weight the one wins whose last link has the smaller i, then the larger j,
    and so on backwards.
    """
    links = rows.sort_values(["i", "j"], ascending=[True, False])
    columns = {j: n for n, j in enumerate(sorted(set(links["j"])), 1)}
    tree: dict[int, tuple] = {}
    nothing = (0.0, 0, 0, None)
    came_from, heaviest = [], nothing
    for at, (i, j, score) in enumerate(zip(links["i"], links["j"], links["score"], strict=True)):
        column = columns[j]
        before, slot = nothing, column - 1
        while slot:
            before = max(before, tree.get(slot, nothing), key=lambda chain: chain[:3])
            slot &= slot - 1
        chain = (before[0] + score, -i, column, at)
        came_from.append(before[3])
        heaviest = max(heaviest, chain, key=lambda chain: chain[:3])
        slot = column
        while slot <= len(columns):
            tree[slot] = max(tree.get(slot, nothing), chain, key=lambda chain: chain[:3])
            slot += slot & -slot
    kept, at = [], heaviest[3]
    while at is not None:
        kept.append(at)
        at = came_from[at]
    return links.iloc[kept[::-1]][["pair_id", "old_id", "new_id", "score"]]


def similar(old_left: DataFrame, new_left: DataFrame, floor: float) -> DataFrame:
    """Order-preserving links at or above ``floor`` over what the exact passes left.

    Both sides belong to one draft pair of at most 400 scenes each (the import
    limit). The length bound drops pairs that cannot reach the floor before any
    text is compared, and only scored survivors enter the chain.
    """
    def side(frame, s, rank):
        body = F.array_join("texts", "\n")
        return frame.select(PAIR, F.col("scene_id").alias(f"{s}_id"), F.col("position").alias(rank),
                            F.col("heading").alias(f"{s}_heading"), body.alias(f"{s}_body"))
    o, n = side(old_left, "old", "i"), side(new_left, "new", "j")
    cand = o.join(n, PAIR).filter(similarity.scene_score_bound(
        F.col("old_heading"), F.col("new_heading"), F.col("old_body"), F.col("new_body")) >= floor)
    scored = cand.withColumn("score", similarity.scene_score(
        F.col("old_heading"), F.col("new_heading"), F.col("old_body"), F.col("new_body"))).filter(
        F.col("score") >= floor)
    ranked = scored.select(PAIR, "old_id", "new_id", (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "score")
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    return ranked.groupBy(PAIR).applyInPandas(best_chain, ", ".join(
        f"{c} {kinds[c]}" for c in (PAIR, "old_id", "new_id", "score")))


def align(old: DataFrame, new: DataFrame, confirmed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pairs, suggestions, inserted and deleted scenes of many draft pairs."""
    exact = exact_passes(old, new, confirmed)
    links = durable(similar(exact["old_left"], exact["new_left"], vocab.STRONG_MATCH))
    pairs = exact["pairs"].unionByName(links.select(
        PAIR, "old_id", "new_id", F.lit("modified").alias("kind"), F.lit("similarity").alias("method")))
    old_rest, new_rest = _without(exact["old_left"], links, "old_id"), _without(exact["new_left"], links, "new_id")
    return {"pairs": pairs, "suggestions": similar(old_rest, new_rest, vocab.WEAK_MATCH),
            "inserted": new_rest.select(PAIR, F.col("scene_id").alias("new_id")),
            "deleted": exact["deleted"].unionByName(old_rest.select(PAIR, F.col("scene_id").alias("old_id")))}


def align_lines(scene_pairs: DataFrame, units: DataFrame, floor: float = 0.5, hot_rows: int | None = None) -> DataFrame:
    """scene_pair, new_unit_id, old_unit_id, same.

    ``scene_pairs``: old_id, new_id. ``units``: scene_id, unit_id, sequence_index, text.
    The n-th line of some text is paired with the n-th such line of the other side, an equi
    join with one pair a line at most; the longest set of pairs that rises on both sides is
    the lines kept word for word. Between two kept lines the n-th line left on one side
    revises the n-th left on the other if twice their common words reach ``floor`` of the words
    of both. A line without text is never kept. Everything but the choice of the rising
    set, which sees two places a pair, is joins and scans.
    """
    name = F.concat_ws("|", "old_id", "new_id")
    at = [F.col("sequence_index"), F.col("unit_id")]

    def side(column: str, s: str, rank: str) -> DataFrame:
        rows = scene_pairs.select(name.alias(PAIR), F.col(column).alias("scene_id")).distinct().join(units, "scene_id")
        rows = Scan(rows, [PAIR], at, hot_rows).ordinal(rank).done()
        return durable(Scan(rows, [PAIR, "text"], at, hot_rows).ordinal("_nth").done().select(
            PAIR, F.col("unit_id").alias(f"{s}_id"), rank, "text", "_nth"))
    old, new = side("old_id", "old", "i"), side("new_id", "new", "j")
    paired = old.join(new, [PAIR, "text", "_nth"]).select(PAIR, "old_id", "new_id", "i", "j", F.lit(1.0).alias("score"))
    kinds = units.schema["unit_id"].dataType.simpleString()
    kept = durable(paired.groupBy(PAIR).applyInPandas(best_chain, f"{PAIR} string, old_id {kinds}, new_id {kinds}, score double"))

    def left(frame: DataFrame, s: str, rank: str) -> DataFrame:
        """The lines not kept, by the number of kept lines above and their place below those."""
        marked = frame.join(kept.select(PAIR, f"{s}_id", F.lit(1).alias("_kept")), [PAIR, f"{s}_id"], "left")
        gap = Scan(marked, [PAIR], [F.col(rank)], hot_rows).total("_gap", F.coalesce("_kept", F.lit(0))).done()
        return Scan(gap.filter("_kept IS NULL"), [PAIR, "_gap"], [F.col(rank)], hot_rows).ordinal("_nth").done().select(
            PAIR, "_gap", "_nth", f"{s}_id", F.array_distinct(F.split("text", r"\s+")).alias(f"_{s}_words"))
    share = 2 * F.size(F.array_intersect("_old_words", "_new_words")) / (F.size("_old_words") + F.size("_new_words"))
    revised = left(old, "old", "i").join(left(new, "new", "j"), [PAIR, "_gap", "_nth"]).filter(share >= floor)
    columns = [F.col(PAIR).alias("scene_pair"), F.col("new_id").alias("new_unit_id"), F.col("old_id").alias("old_unit_id")]
    return kept.select(*columns, F.lit(True).alias("same")).unionByName(revised.select(*columns, F.lit(False).alias("same")))


def carry_graph(draft_pairs: DataFrame, scene_map: DataFrame, unit_map: DataFrame, tables: dict[str, DataFrame]
                ) -> dict[str, DataFrame]:
    """What a draft link copies: facts whose scenes and evidence both carried.

    ``draft_pairs``: script_id (new), old_script_id. ``scene_map``/``unit_map``:
    old_*_id, new_*_id of unchanged scenes. An entity the draft already has by
    (type, name) takes the facts; any other is cloned under an id hashed from
    (draft, old id), so a repeated link writes the same rows.
    """
    facts = tables["assertions"].filter("active").withColumnRenamed("script_id", "old_script_id").join(
        draft_pairs, "old_script_id")
    units = unit_map.select(F.col("old_unit_id").alias("source_unit_id"), F.col("new_unit_id").alias("_unit"))
    facts = facts.join(units, "source_unit_id")
    for side in ("subject", "object"):
        scenes = scene_map.select(F.col("old_scene_id").alias(f"{side}_scene_id"), F.col("new_scene_id").alias(f"_{side}"))
        facts = facts.join(scenes, f"{side}_scene_id", "left").filter(
            F.col(f"{side}_scene_id").isNull() | F.col(f"_{side}").isNotNull())
    attributes = tables["attributes"].filter("active").join(units, "source_unit_id").join(
        tables["entities"].select("entity_id", F.col("script_id").alias("old_script_id")), "entity_id").join(
        draft_pairs, "old_script_id")
    ends = F.array_compact(F.array("subject_entity_id", "object_entity_id"))
    wanted = facts.select("script_id", F.explode(ends).alias("old_entity_id")).unionByName(
        attributes.select("script_id", F.col("entity_id").alias("old_entity_id"))).distinct()
    source = tables["entities"].select(F.col("entity_id").alias("old_entity_id"), "entity_type", "canonical_name",
                                       "normalized_name")
    there = tables["entities"].select("script_id", "entity_type", "normalized_name", F.col("entity_id").alias("_there"))
    kind = tables["entities"].schema["entity_id"].dataType
    fresh = F.xxhash64("script_id", "old_entity_id").cast(kind)
    entity_map = durable(wanted.join(source, "old_entity_id").join(
        there, ["script_id", "entity_type", "normalized_name"], "left").withColumn(
        "entity_id", F.coalesce("_there", fresh)).withColumn("cloned", F.col("_there").isNull()).drop("_there"))
    m = entity_map.select("script_id", "old_entity_id", "entity_id")
    for side in ("subject", "object"):
        e = m.select("script_id", F.col("old_entity_id").alias(f"{side}_entity_id"), F.col("entity_id").alias(f"_{side}_e"))
        facts = facts.join(e, ["script_id", f"{side}_entity_id"], "left")
    carried = facts.select(
        "script_id", F.col("assertion_id").alias("carried_from"), "subject_kind", F.col("_subject_e").alias("subject_entity_id"),
        F.col("_subject").alias("subject_scene_id"), "predicate", "object_kind", F.col("_object_e").alias("object_entity_id"),
        F.col("_object").alias("object_scene_id"), F.col("_unit").alias("source_unit_id"), "confidence")
    values = attributes.withColumnRenamed("entity_id", "old_entity_id").join(m, ["script_id", "old_entity_id"]).select(
        "script_id", "entity_id", "key", "value", F.col("_unit").alias("source_unit_id"))
    clones = entity_map.filter("cloned").select(
        "script_id", "entity_id", "entity_type", "canonical_name", "normalized_name",
        F.col("old_entity_id").alias("predecessor_entity_id"))
    out = {"assertions": carried, "attributes": values, "entities": clones, "entity_map": m}
    if "cache" in tables:
        done = tables["cache"].filter("status = 'completed'").join(
            scene_map.select(F.col("old_scene_id").alias("scene_id"), "new_scene_id"), "scene_id")
        out["cache"] = done.select(F.col("new_scene_id").alias("scene_id"), "input_hash", "prompt_version", "model_id",
                                   "status").distinct()
    return out


def carry_speakers(unit_map: DataFrame, old_units: DataFrame, entity_map: DataFrame) -> DataFrame:
    """The resolved speaker of each carried line, mapped forward."""
    spoke = old_units.filter("speaker_entity_id IS NOT NULL").select(
        F.col("unit_id").alias("old_unit_id"), F.col("speaker_entity_id").alias("old_entity_id"))
    return unit_map.join(spoke, "old_unit_id").join(entity_map, "old_entity_id").select(
        F.col("new_unit_id").alias("unit_id"), F.col("entity_id").alias("speaker_entity_id"))


def chain_of(scripts: DataFrame) -> DataFrame:
    """The first draft and the depth of every script, by doubling steps.

    Rounds grow with the logarithm of the longest chain. A loop, which linking
    refuses, would never reach a first draft; such scripts are left with root null.
    """
    links = durable(scripts.select("script_id", F.coalesce("predecessor_script_id", "script_id").alias("root_id"), F.when(
        F.col("predecessor_script_id").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    ends = scripts.filter("predecessor_script_id IS NULL").select(F.col("script_id").alias("root_id"))
    limit = 1
    while True:
        open_links = links.join(ends, "root_id", "left_anti")
        if limit > (1 << 40) or open_links.isEmpty():
            return links.join(ends.withColumn("_e", F.lit(True)), "root_id", "left").select(
                "script_id", F.when(F.col("_e"), F.col("root_id")).alias("root_id"), "depth")
        up = links.select(F.col("script_id").alias("root_id"), F.col("root_id").alias("_up"), F.col("depth").alias("_d"))
        links = durable(links.join(up, "root_id", "left").select(
            "script_id", F.coalesce("_up", "root_id").alias("root_id"),
            (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
        limit *= 2


def link_refusals(requests: DataFrame, scripts: DataFrame, assertions: DataFrame) -> DataFrame:
    """Why a link may not be made, or null. ``requests``: script_id, predecessor.

    ``scripts`` carries root_id and depth from ``chain_of``: a request closes a
    loop when the predecessor descends from the script, that is when both share a
    root and the predecessor is deeper.
    """
    own = scripts.select("script_id", "predecessor_script_id", F.col("root_id").alias("_root"), F.col("depth").alias("_depth"))
    old = scripts.select(F.col("script_id").alias("predecessor"), F.col("root_id").alias("_p_root"),
                         F.col("depth").alias("_p_depth"))
    graphed = assertions.select("script_id").distinct().withColumn("_graph", F.lit(True))
    rows = requests.join(own, "script_id", "left").join(old, "predecessor", "left").join(graphed, "script_id", "left")
    reason = (F.when(F.col("script_id") == F.col("predecessor"), "itself")
              .when(F.col("predecessor_script_id").isNotNull(), "already_linked")
              .when((F.col("_root") == F.col("_p_root")) & (F.col("_p_depth") > F.col("_depth")), "loop")
              .when(F.col("_graph"), "has_graph"))
    return rows.select("script_id", "predecessor", reason.alias("reason"))


def candidates(scripts: DataFrame) -> DataFrame:
    """Scripts a draft could follow: same title, no successor, a graph to carry."""
    taken = scripts.filter("predecessor_script_id IS NOT NULL").select(
        F.col("predecessor_script_id").alias("script_id")).distinct()
    ready = scripts.filter(F.col("graph_status").isin("ready", "partially_ready")).join(taken, "script_id", "left_anti")
    return ready.withColumn("title_key", F.lower("title")).select("title_key", F.col("script_id").alias("candidate_id"))


def blocked_reports(scenes: DataFrame, cache: DataFrame) -> DataFrame:
    """Drafts whose changed scenes are not all read; their report is refused."""
    changed = scenes.filter(F.col("lineage_kind").isin("modified", "inserted") & ~F.col("omitted"))
    done = cache.filter("status = 'completed'").select("scene_id")
    return changed.join(done, "scene_id", "left_anti").groupBy("script_id").agg(F.count(F.lit(1)).alias("unread"))


def attribute_moves(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Values that changed between drafts; a key only one side holds is no change.

    ``pairs``: script_id, old_entity_id, entity_id.
    """
    live = attributes.filter("active")
    old = live.select(F.col("entity_id").alias("old_entity_id"), "key", F.col("value").alias("before"))
    new = live.select("entity_id", "key", F.col("value").alias("after"))
    return pairs.join(old, "old_entity_id").join(new, ["entity_id", "key"]).filter("before <> after")


def lost_introductions(pairs: DataFrame, assertions: DataFrame) -> DataFrame:
    """Entities the old draft introduced that this one still uses but does not introduce."""
    live = assertions.filter("active")
    intro = live.filter("predicate = 'establishes'").select("object_entity_id").distinct()
    used = endpoint_frame(live.filter(F.col("predicate").isin(*vocab.USE_PREDICATES))).select("entity_id").distinct()
    return (pairs.join(intro.withColumnRenamed("object_entity_id", "old_entity_id"), "old_entity_id", "left_semi")
            .join(intro.withColumnRenamed("object_entity_id", "entity_id"), "entity_id", "left_anti")
            .join(used, "entity_id", "left_semi"))


def draft_report(drafts: DataFrame, new: DataFrame, old: DataFrame, aliases: DataFrame, attributes: DataFrame,
                 assertions: DataFrame) -> DataFrame:
    """Counts and severity per draft from combined aggregates.

    ``new``/``old``: script_pair, entities of each side (see ``joins.lineage``).
    """
    resolved = durable(joins.lineage(new, old, aliases))
    pairs = resolved.filter("source_id IS NOT NULL").select(
        "script_pair", F.col("source_id").alias("old_entity_id"), "entity_id")
    live_old = endpoint_frame(assertions.filter("active")).select("entity_id").distinct()
    gone = old.join(pairs.select("script_pair", F.col("old_entity_id").alias("entity_id")), ["script_pair", "entity_id"],
                    "left_anti").join(live_old, "entity_id", "left_semi")

    def count(frame, name):
        return frame.groupBy("script_pair").agg(F.count(F.lit(1)).alias(name))
    parts = [count(pairs, "kept"), count(resolved.filter("how = 'added'"), "added"), count(gone, "removed"),
             count(attribute_moves(pairs, attributes), "attribute_changes"),
             count(lost_introductions(pairs, assertions), "lost_introductions")]
    rows = drafts
    for part in parts:
        rows = rows.join(part, "script_pair", "left")
    rows = rows.na.fill(0, ["kept", "added", "removed", "attribute_changes", "lost_introductions"])
    severity = (F.when(F.col("lost_introductions") > 0, "high")
                .when((F.col("attribute_changes") > 0) | (F.col("removed") > 0), "medium").otherwise("low"))
    return rows.withColumn("severity", severity)


def changed_lines(scenes: DataFrame, units: DataFrame, assertions: DataFrame, entities: DataFrame
                  ) -> tuple[DataFrame, DataFrame]:
    """(lines that differ from their predecessor, entities each changed scene affects).

    ``scenes``: scene_id, script_id, predecessor_scene_id, lineage_kind. ``units``:
    unit_id, scene_id, text, predecessor_unit_id.
    """
    changed = scenes.filter(F.col("lineage_kind").isin("modified", "inserted"))
    before = units.select(F.col("unit_id").alias("predecessor_unit_id"), F.col("text").alias("before"))
    lines = units.join(changed.select("scene_id"), "scene_id", "left_semi").join(
        before, "predecessor_unit_id", "left").withColumn("before", F.coalesce("before", F.lit(""))).filter(
        "before <> text")
    # A fact's ends are told in its own row, which also has its scene.
    ends = F.array_distinct(F.array_compact(F.array("subject_entity_id", "object_entity_id")))
    cited = assertions.filter("active").select(F.col("unit_scene_id").alias("scene_id"), F.explode(ends).alias("entity_id")).distinct()
    edited = changed.join(lines.select("scene_id").distinct(), "scene_id", "left_semi")
    now = edited.select("scene_id").join(cited, "scene_id")
    past = edited.filter("predecessor_scene_id IS NOT NULL").select(
        F.col("scene_id").alias("_new"), F.col("predecessor_scene_id").alias("scene_id"), "script_id").join(
        cited, "scene_id").select(F.col("_new").alias("scene_id"), "script_id",
                                  F.col("entity_id").alias("predecessor_entity_id"))
    forward = past.join(entities.filter("predecessor_entity_id IS NOT NULL").select(
        "script_id", "predecessor_entity_id", "entity_id"), ["script_id", "predecessor_entity_id"]).select(
        "scene_id", "entity_id")
    return lines, now.unionByName(forward).distinct()

"""Orphaned references, cast renames in edits, and continuity evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions import headings, names, phrases, words
from plotline.functions.text import evaluated
from plotline.operators.filters import first_in
from plotline.operators.joins import endpoint_frame
from plotline.session import durable


def score() -> F.Column:
    """How close a fact is to what is asked: same entity, wanted predicate, near scene."""
    distance = F.abs(F.col("sequence_index") - F.col("origin_index"))
    return (F.lit(100.0) + F.when(F.col("relevant"), 20.0).otherwise(0.0)
            - F.least(distance, F.lit(50)) * 0.5)


def ranked(rows: DataFrame, cap: int = vocab.MAX_EVIDENCE_ITEMS) -> DataFrame:
    """The first items per request by score, and whether more were found.

    The packet's size is its definition. Counting combines before the shuffle
    and the cut is applied per partition first, so a request matching very many
    facts never gathers them in one task.
    """
    scored = rows.withColumn("score", score())
    order = [F.col("score").desc(), F.col("sequence_index"), F.col("assertion_id")]
    totals = rows.groupBy("request_id").agg((F.count(F.lit(1)) > cap).alias("truncated"))
    return first_in(scored, ["request_id"], order, cap, "place").join(totals, "request_id")


def touched_in_script(assertions: DataFrame) -> DataFrame:
    """script_id, assertion_id, entity_id: one row per entity a fact touches."""
    ends = F.array_distinct(F.array_compact(F.array("subject_entity_id", "object_entity_id")))
    return assertions.select("script_id", "assertion_id", F.explode(ends).alias("entity_id"))


def evidence(requests: DataFrame, assertions: DataFrame, scenes: DataFrame,
             predicates: list[str] | None = None) -> DataFrame:
    """Evidence for many (request, script, origin scene, entity) rows at once.

    ``assertions`` carries in_scene. A fact touching two asked entities counts
    once. ``relation`` places it before, in, or after the origin scene.
    """
    live = assertions.filter("active")
    if "script_id" in assertions.columns:
        ends = touched_in_script(live)
        asked = requests.join(ends, ["script_id", "entity_id"])
    else:
        asked = requests.join(endpoint_frame(live), "entity_id")
    asked = asked.select("request_id", "script_id", "origin_index", "assertion_id").distinct()
    placed = scenes.select(F.col("scene_id").alias("in_scene"), "sequence_index", "number")
    facts = live.drop("script_id") if "script_id" not in requests.columns else live
    rows = asked.join(facts, ["assertion_id", "script_id"]).join(placed, "in_scene").withColumn(
        "relevant", F.lit(True) if predicates is None else F.col("predicate").isin(*predicates))
    rows = durable(rows)
    relation = (F.when(F.col("sequence_index") == F.col("origin_index"), "same_scene")
                .when(F.col("sequence_index") < F.col("origin_index"), "earlier_same_entity")
                .otherwise("later_same_entity"))
    return ranked(rows).withColumn("relation", relation)


def neighbours(requests: DataFrame, assertions: DataFrame, labels: DataFrame,
               cap: int = vocab.MAX_NEIGHBOURS) -> DataFrame:
    """Entities one edge from the asked ones; the first ``cap`` labels per request."""
    ends = endpoint_frame(assertions.filter("active"))
    touched = requests.join(ends, "entity_id").select("request_id", "assertion_id").distinct()
    others = touched.join(ends, "assertion_id").select("request_id", "entity_id").distinct()
    others = others.join(requests.select("request_id", "entity_id"), ["request_id", "entity_id"],
                         "left_anti")
    named = others.join(labels, "entity_id").select("request_id", "label").distinct()
    return first_in(named, ["request_id"], [F.col("label")], cap)


def orphaned(removed: DataFrame, assertions: DataFrame) -> DataFrame:
    """Entities an edit stops introducing while other uses stay.

    ``removed``: change_set_id, assertion_id - every assertion the change set
    removes. ``assertions`` carries in_scene and scene_label. A use the same
    edit removes is no later use. One row per surviving use; the finding itself
    is its aggregate, see ``orphan_findings``.
    """
    live = assertions.filter("active")
    gone = removed.filter("assertion_id IS NOT NULL").select("change_set_id", "assertion_id").distinct()
    dropped = gone.join(live.filter("predicate = 'establishes'")
                        .select("assertion_id", F.col("object_entity_id").alias("entity_id")),
                        "assertion_id").select("change_set_id", "entity_id").distinct()
    intro = live.filter("predicate = 'establishes'").select(
        F.col("object_entity_id").alias("entity_id"), "assertion_id")
    # Introductions left per (change set, entity): all of them less those removed.
    total = intro.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_all"))
    cut = (gone.join(intro, "assertion_id").groupBy("change_set_id", "entity_id")
           .agg(F.count(F.lit(1)).alias("_cut")))
    lost = (dropped.join(total, "entity_id").join(cut, ["change_set_id", "entity_id"])
            .filter(F.col("_all") == F.col("_cut")).select("change_set_id", "entity_id"))
    uses = live.filter(F.col("predicate").isin(*vocab.USE_PREDICATES))
    used = (endpoint_frame(uses).join(uses.select("assertion_id", "in_scene", "scene_label",
                                                  "source_unit_id"), "assertion_id"))
    return lost.join(used, "entity_id").join(gone, ["change_set_id", "assertion_id"], "left_anti")


def orphan_findings(uses: DataFrame, labels: DataFrame) -> DataFrame:
    """One finding per orphaned entity with the scenes that still use it."""
    scenes = F.array_sort(F.collect_set(F.coalesce("scene_label", F.lit("—"))))
    return (uses.groupBy("change_set_id", "entity_id")
            .agg(scenes.alias("scenes"), F.count(F.lit(1)).alias("uses"))
            .join(labels, "entity_id")
            .withColumn("message", phrases.orphan_message(F.col("label"), F.col("scenes"))))


def cast_renames(edits: DataFrame, cues: DataFrame) -> DataFrame:
    """Cues an edit renames, with every other cue that keeps the old name.

    ``edits``: unit_id, script_id, current_text, proposed_text of character
    units. ``cues``: unit_id, script_id, text, scene_label. Old cues are counted
    per (script, name) first; the edited line is then taken off, so a common
    name is never expanded into pairs.
    """
    def said(frame, column, name):
        return evaluated(frame, name, headings.cue(F.col(column))["name"])
    both = said(said(edits, "current_text", "old_label"), "proposed_text", "new_label").filter(
        "old_label IS NOT NULL AND new_label IS NOT NULL")
    both = evaluated(both, "old_key", names.normalize(F.col("old_label")))
    renamed = evaluated(both, "new_key", names.normalize(F.col("new_label"))).filter(
        "old_key <> new_key").select("unit_id", "script_id", "old_label", "new_label", "old_key", "new_key")
    named = said(cues, "text", "_said").filter("_said IS NOT NULL")
    named = named.withColumn("old_key", names.normalize(F.col("_said")))
    by_scene = named.groupBy("script_id", "old_key", "scene_label").agg(
        F.count(F.lit(1)).alias("_n"))
    own = named.select("unit_id", F.col("scene_label").alias("_own_label"))
    rest = (renamed.join(own, "unit_id", "left").join(by_scene, ["script_id", "old_key"], "left")
            .withColumn("_left", F.col("_n") - F.when(
                F.col("scene_label").eqNullSafe(F.col("_own_label")) & F.col("_n").isNotNull(), 1)
                .otherwise(0)))
    out = rest.groupBy("unit_id", "script_id", "old_label", "new_label").agg(
        F.coalesce(F.sum("_left"), F.lit(0)).alias("lines"),
        F.array_sort(F.collect_set(F.when(F.col("_left") > 0, F.col("scene_label")))).alias("scenes"))
    return out.withColumn("message", phrases.rename_message(
        F.col("old_label"), F.col("new_label"), F.col("lines"), F.col("scenes")))


def stale_findings(findings: DataFrame, version: str, every: bool = False) -> DataFrame:
    """open findings still to be restated.

    ``findings``: finding_id, status, message, payload (JSON or null). A finding
    restated under ``version`` is done; the voice is judged on the message it was
    restated from, if it was. ``every`` takes each open finding.
    """
    if every:
        return findings.filter("status = 'open'")
    done = F.coalesce(F.get_json_object("payload", "$.restated_under") == version, F.lit(False))
    source = F.coalesce(F.nullif(F.get_json_object("payload", "$.restated_from"), F.lit("")), F.col("message"))
    return findings.filter("status = 'open'").filter(~done & words.reads_as_argued(source))

"""Given verdicts verified against the edit, then turned into changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions import words
from plotline.functions.text import evaluated
from plotline.operators import aggregates
from plotline.plans import continuity, diff

VERDICTS = ["holds", "changed", "removed"]


def edit_texts(edits: DataFrame) -> DataFrame:
    """One row per proposal: all current and all proposed lines, case-folded.

    A proposal edits lines of one script, which the import limits bound.
    """
    def joined(column):
        rows = F.array_sort(F.collect_list(F.struct("position", F.col(column).alias("t"))))
        return F.lower(F.array_join(F.transform(rows, lambda r: F.coalesce(r["t"], F.lit(""))), " "))
    return edits.groupBy("batch_id").agg(joined("current_text").alias("current_all"),
                                         joined("proposed_text").alias("proposed_all"))


def _first_verdicts(verdicts: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the verdict in force per listed item, rejected verdicts with a reason)."""
    known = listed.select("batch_id", "item_id", F.lit(True).alias("_listed"))
    rows = verdicts.join(known, ["batch_id", "item_id"], "left")
    sound = F.col("_listed").isNotNull() & F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))
    first = rows.filter(sound).groupBy("batch_id", "item_id").agg(
        F.min(F.struct("position", "verdict", "new_value")).alias("v"))
    reason = (F.when(F.col("_listed").isNull(), "unlisted").when(~sound, "unknown_verdict")
              .when(F.col("position") != F.col("v.position"), "duplicate"))
    rejected = rows.join(first, ["batch_id", "item_id"], "left").withColumn("reason", reason).filter(
        "reason IS NOT NULL").select("batch_id", "item_id", "reason")
    return first.select("batch_id", "item_id", "v.verdict", "v.new_value"), rejected


def _held(names: Column, text: Column) -> Column:
    return F.filter(names, lambda w: F.contains(text, w))


def _words(label: Column, others: Column) -> Column:
    """The significant words of an endpoint's label and of each of its other names."""
    every = F.concat(F.array(F.coalesce(label, F.lit(""))), F.coalesce(others, F.array().cast("array<string>")))
    return F.transform(every, words.significant)


def _visible(names: Column, values: Column, before: Column, after: Column) -> Column:
    """Whether a name went, or lost a word that is no stored attribute value; ``before`` and ``after``: words the texts hold."""
    stored = F.coalesce(values, F.array().cast("array<string>"))

    def gone(parts):
        had, has = F.size(F.array_intersect(parts, before)), F.size(F.array_intersect(parts, after))
        wholly = (had > 0) & (has == 0)
        degraded = ((had == F.size(parts)) & (has < F.size(parts))
                    & (F.size(F.array_except(F.array_except(parts, after), stored)) > 0))
        return (F.size(parts) > 0) & (wholly | degraded)
    return F.exists(names, gone)


def _named(names: Column, spoken: Column) -> Column:
    return F.exists(names, lambda parts: (F.size(parts) > 0) & (F.size(F.array_except(parts, spoken)) == 0))


def verify_assertions(listed: DataFrame, verdicts: DataFrame, edits: DataFrame,
                      attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final verdict per listed assertion, rejected verdicts).

    ``listed``: batch_id, item_id, subject/object labels, names (arrays) and
    entity ids, source_unit_id, evidence. A hold whose words are gone is a
    removal; a removal the edit does not show is a hold; no verdict is a hold
    and a coverage miss.
    """
    first, rejected = _first_verdicts(verdicts, listed)
    unit = edits.select("batch_id", F.col("unit_id").alias("source_unit_id"),
                        F.lower("proposed_text").alias("_unit"))
    stored = attributes.filter("entity_id IS NOT NULL").groupBy("batch_id", "entity_id").agg(F.array_distinct(
        F.flatten(F.collect_set(words.significant(F.col("value"))))).alias("_w"))

    def values(frame, side):
        v = stored.select("batch_id", F.col("entity_id").alias(f"{side}_entity_id"), F.col("_w").alias(f"_{side}_w"))
        return frame.join(v, ["batch_id", f"{side}_entity_id"], "left")
    rows = listed.join(first, ["batch_id", "item_id"], "left").join(unit, ["batch_id", "source_unit_id"], "left")
    # The edited line leaves at once as what it tells, so no later join shuffles it once for each item.
    evidence = F.lower(F.coalesce("evidence", F.lit("")))
    rows = evaluated(rows, "_edited", F.when(F.col("_unit").isNotNull(), F.struct(
        ((evidence != "") & ~F.contains("_unit", evidence)).alias("vanished")))).drop("_unit")
    edited = F.col("_edited").isNotNull()
    vanished = F.coalesce(F.col("_edited.vanished"), F.lit(False))
    rows = values(values(rows, "subject"), "object")
    for side in ("subject", "object"):
        rows = evaluated(rows, f"_{side}", _words(F.col(side), F.col(f"{side}_names")))
    rows = evaluated(rows, "_said", F.array_distinct(F.flatten(F.concat("_subject", "_object"))))
    rows = rows.join(evaluated(edit_texts(edits), "_spoken", words.significant(F.col("proposed_all"))), "batch_id")
    # An item of an edited line is judged by the words both texts hold, any other by those spoken; each is looked up once.
    rows = evaluated(rows, "_seen", F.when(edited, F.struct(
        _held(F.col("_said"), F.col("current_all")).alias("before"), _held(F.col("_said"), F.col("proposed_all")).alias("after"))))
    rows = evaluated(rows, "_heard", F.when(~edited, F.array_intersect("_said", "_spoken")))
    step = F.when((F.col("verdict") == "holds") & vanished, "removed").otherwise(F.col("verdict"))
    before, after, spoken = F.col("_seen.before"), F.col("_seen.after"), F.col("_heard")
    shown = (_visible(F.col("_subject"), F.col("_subject_w"), before, after)
             | _visible(F.col("_object"), F.col("_object_w"), before, after))
    named = _named(F.col("_subject"), spoken) | _named(F.col("_object"), spoken)
    rows = evaluated(rows.withColumn("_step", step), "_kept", F.when(F.col("_step") == "removed", F.when(edited, shown).otherwise(named)))
    kept = F.col("_kept")
    final = F.when((F.col("_step") == "removed") & ~kept, "holds").otherwise(F.col("_step"))
    reason = (F.when(F.col("verdict").isNull(), "coverage_miss")
              .when((F.col("_step") == "removed") & ~kept, F.when(edited, "not_visible").otherwise("never_named"))
              .when((F.col("verdict") == "holds") & vanished, "vanished_evidence"))
    return rows.withColumn("final", F.coalesce(final, F.lit("holds"))).withColumn("reason", reason).select(
        "batch_id", "item_id", "verdict", "final", "reason"), rejected


def verify_attributes(listed: DataFrame, verdicts: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A value changes only with a new value, and only where the edit states the old one."""
    first, rejected = _first_verdicts(verdicts, listed)
    rows = listed.join(first, ["batch_id", "item_id"], "left").join(edit_texts(edits), "batch_id")
    empty = (F.col("verdict") == "changed") & (F.trim(F.coalesce("new_value", F.lit(""))) == "")
    value = F.lower(F.coalesce("value", F.lit("")))
    unstated = F.col("verdict").isin("changed", "removed") & ~empty & (value != "") & ~F.contains("current_all", value)
    final = F.when(F.col("verdict").isNull() | empty | unstated, "holds").otherwise(F.col("verdict"))
    reason = (F.when(F.col("verdict").isNull(), "coverage_miss").when(empty, "no_new_value")
              .when(unstated, "value_not_stated"))
    return rows.select("batch_id", "item_id", "entity_id", "key", "value", "verdict", final.alias("final"),
                       F.when(final == "changed", F.col("new_value")).alias("new_value"),
                       reason.alias("reason")), rejected


def verdict_edges(listed: DataFrame, final: DataFrame, new_edges: DataFrame | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """The accepted and proposed edge sets the verdicts imply.

    ``listed`` carries the diff columns of each edge. New edges are proposed only.
    """
    rows = listed.join(final.select("batch_id", "item_id", "final"), ["batch_id", "item_id"])
    accepted = rows.drop("final")
    proposed = rows.filter("final <> 'removed'").drop("final")
    if new_edges is not None:
        proposed = proposed.unionByName(new_edges, allowMissingColumns=True)
    return accepted, proposed


def attribute_changes(final: DataFrame) -> DataFrame:
    """The operations of attributes that changed or went."""
    return final.filter("final <> 'holds'").select(
        "batch_id", F.when(F.col("final") == "changed", "set_entity_attribute").otherwise("remove_entity_attribute")
        .alias("operation_type"), F.col("item_id").alias("target_id"), "entity_id", "key",
        F.col("value").alias("before"), F.when(F.col("final") == "changed", F.col("new_value")).alias("after"))


def new_endpoints(edges: DataFrame, declared: DataFrame, entities: DataFrame) -> DataFrame:
    """Endpoints of new edges: declared with the reply, or existing by name and legal type.

    ``edges``: batch_id, script_id, predicate, side, local_name (normalized). An
    existing name shared across types resolves only to a type the side accepts.
    """
    allowed = [x for name, sig in vocab.SIGNATURES.items() for x in (
        F.lit(name), F.array(*[F.array(*[F.lit(t) for t in (sig[i] or vocab.ENTITY_TYPES)]) for i in (2, 3)]))]
    wanted = F.create_map(*allowed)[F.col("predicate")]
    side = F.when(F.col("side") == "subject", 1).otherwise(2)
    rows = edges.distinct().withColumn("_ok", F.element_at(wanted, side))
    fresh = declared.groupBy("batch_id", F.col("normalized_name").alias("local_name")).agg(F.max("entity_type").alias("new_type"))
    # A name is one row with the first entity of each type, at most the vocabulary's types, however many entities share it.
    first = entities.filter(F.col("entity_type").isin(*vocab.ENTITY_TYPES)).groupBy(
        "script_id", F.col("normalized_name").alias("local_name"), F.col("entity_type").alias("_old")).agg(
        F.min("entity_id").alias("entity_id"))
    old = first.groupBy("script_id", "local_name").agg(F.collect_list(F.struct("entity_id", "_old")).alias("_olds"))
    hits = rows.join(fresh, ["batch_id", "local_name"], "left").join(old, ["script_id", "local_name"], "left")
    hits = hits.withColumn("_e", F.array_min(F.filter("_olds", lambda x: F.array_contains("_ok", x["_old"]))))
    return hits.select(*edges.columns, "new_type", F.when(F.col("new_type").isNull(), F.col("_e.entity_id")).alias("entity_id"),
                       F.coalesce("new_type", "_e._old").alias("entity_type"))


def kept_new_items(entities: DataFrame, assertions: DataFrame, surfaces: DataFrame
                   ) -> tuple[DataFrame, DataFrame]:
    """Proposed entities the graph lacks under any surface, and the edges touching one.

    ``surfaces``: script_id, entity_type, name (normalized names and aliases).
    ``entities``: call_id, script_id, local_id, entity_type, normalized_name.
    """
    known = surfaces.select("script_id", "entity_type", F.col("name").alias("normalized_name")).distinct()
    fresh = entities.join(known, ["script_id", "entity_type", "normalized_name"], "left_anti")
    mine = fresh.select("call_id", "local_id").distinct()
    ends = F.array_compact(F.array(F.when(F.col("subject_kind") == "entity", F.col("s")),
                                   F.when(F.col("object_kind") == "entity", F.col("o"))))
    touched = assertions.select("call_id", "position", F.explode(ends).alias("local_id")).join(
        mine, ["call_id", "local_id"], "left_semi")
    edges = assertions.join(touched.select("call_id", "position").distinct(), ["call_id", "position"], "left_semi")
    cited = touched.select("call_id", "local_id").distinct()
    return fresh.join(cited, ["call_id", "local_id"], "left_semi"), edges


def merge_new_items(own: DataFrame, added: DataFrame) -> DataFrame:
    """The judge's own new entities with those it lacks, by (type, name)."""
    key = ["batch_id", "entity_type", "normalized_name"]
    extra = added.groupBy(*key).agg(F.min("local_id").alias("_l")).join(own.select(*key), key, "left_anti")
    return own.unionByName(extra.select(*key, F.concat(F.lit("x:"), "_l").alias("local_id")),
                           allowMissingColumns=True)


def listed_facts(edits: DataFrame, assertions: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Facts an edit puts in question: cited by an edited line, or in an edited scene about
    an entity the lines name.

    ``edits``: batch_id, script_id, scene_id, unit_id, position, current_text,
    proposed_text. ``surfaces``: script_id, entity_id, name. ``assertions`` carries
    unit_scene_id. An assertion has one unit and one scene, so a pair comes from one unit or else from one
    scene: it is made distinct where these met, and the pairs themselves are never shuffled.
    """
    live = assertions.filter("active")
    cited = edits.select("batch_id", F.col("unit_id").alias("source_unit_id")).join(
        live.select("source_unit_id", "assertion_id"), "source_unit_id").dropDuplicates(
        ["source_unit_id", "batch_id", "assertion_id"]).select("batch_id", "assertion_id", F.lit(0).alias("way"))
    both = F.concat_ws(" ", "current_text", "proposed_text")
    # A batch is one row with the words of its lines, under their script, and then one row for each edited scene.
    spoken = edits.select("batch_id", "scene_id", "unit_id", F.struct("script_id", words.significant(both).alias("words")).alias("said")).groupBy(
        "batch_id").agg(F.collect_set("said").alias("said"), F.collect_set("scene_id").alias("_scenes"), F.collect_set("unit_id").alias("units"))
    asked = spoken.select("batch_id", "said", "units", F.explode("_scenes").alias("unit_scene_id"))
    # Names meet the facts before these meet the batches: what is compared is never written or shuffled as pairs.
    sought = surfaces.filter(F.col("script_id").isNotNull()).select(
        "script_id", "entity_id", words.significant(F.col("name")).alias("name_words")).filter(F.size("name_words") > 0)
    ends = F.array_distinct(F.array_compact(F.array("subject_entity_id", "object_entity_id")))
    near = live.select("unit_scene_id", "source_unit_id", "assertion_id", F.explode(ends).alias("entity_id")).join(
        sought, "entity_id").drop("entity_id")
    heard = F.flatten(F.transform(F.filter("said", lambda s: s["script_id"] == F.col("script_id")), lambda s: s["words"]))
    named = F.size(F.array_except("name_words", heard)) == 0
    about = asked.join(near, "unit_scene_id").filter(
        named & ~F.coalesce(F.array_contains("units", F.col("source_unit_id")), F.lit(False))).dropDuplicates(
        ["unit_scene_id", "batch_id", "assertion_id"]).select("batch_id", "assertion_id", F.lit(1).alias("way"))
    return cited.unionByName(about)


def preview(accepted: DataFrame, proposed: DataFrame, facts: DataFrame, labels: DataFrame,
            lifted: DataFrame | None = None) -> dict[str, DataFrame]:
    """Diff, operations, orphan findings with ranked evidence, and severity per proposal.

    ``accepted``/``proposed`` are the edge sets of ``verdict_edges`` keyed by
    batch_id; ``facts`` carries in_scene and scene_label.
    """
    from plotline.session import durable
    changes = durable(diff.diff_edges(accepted, proposed, "batch_id"))
    operations = diff.to_operations(changes, "batch_id")
    removed = changes.filter("state IN ('removed', 'changed')").select(
        F.col("batch_id").alias("change_set_id"), F.col("before.assertion_id").alias("assertion_id"))
    uses = durable(continuity.orphaned(removed, facts))
    findings = continuity.orphan_findings(uses, labels)
    from plotline.operators.filters import first_in
    ranked = first_in(uses.select("change_set_id", "entity_id", "source_unit_id").distinct(),
                      ["change_set_id", "entity_id"], [F.col("source_unit_id")], vocab.FINDING_EVIDENCE_CAP)
    states = changes.select(F.col("batch_id").alias("change_set_id"), "state")
    severity = aggregates.severity(states, findings.select("change_set_id"), lifted)
    return {"diff": changes, "operations": operations, "findings": findings, "evidence": ranked,
            "severity": severity}

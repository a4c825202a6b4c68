"""Applying, undoing and guarding changes.

Tables are immutable: every function takes frames and returns the next frames,
which the caller writes as a new snapshot and switches to. Chains of operations
on one target fold with ``max_by`` over (change set order, sequence), a
combining aggregate, so a target changed very many times is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions.text import strip
from plotline.operators import quality, scans
from plotline.operators.filters import dedupe_key
from plotline.session import durable

def order() -> Column:
    return F.struct("accepted_order", "sequence_index")


def check_versions(change_sets: DataFrame, scripts: DataFrame, edited: DataFrame,
                   units: DataFrame) -> DataFrame:
    """Ok, stale or failed per change set.

    ``edited``: change_set_id, unit_id, base_unit_version. A script that moved
    makes the proposal stale before any unit is looked at.
    """
    current = units.select("unit_id", F.col("current_version").alias("_uv"))
    lines = edited.join(current, "unit_id", "left").groupBy("change_set_id").agg(
        F.bool_or(F.col("_uv").isNull()).alias("_gone"),
        F.bool_or(F.col("_uv") != F.col("base_unit_version")).alias("_moved"))
    rows = change_sets.join(scripts.select("script_id", F.col("current_version").alias("_sv")), "script_id"
                            ).join(lines, "change_set_id", "left")
    verdict = (F.when(F.col("base_script_version") != F.col("_sv"), "stale")
               .when(F.coalesce("_gone", F.lit(False)), "failed")
               .when(F.coalesce("_moved", F.lit(False)), "stale").otherwise("ok"))
    return rows.select("change_set_id", verdict.alias("check"))


def refused_operations(operations: DataFrame) -> DataFrame:
    """Operations that cannot be applied, with the first rule each breaks.

    A change set with any of these is refused whole by ``accepted_only``.
    """
    kind = F.col("operation_type")
    adds = kind.isin("add_assertion", "update_assertion")
    reason = (F.when(~kind.isin(*vocab.OPERATION_TYPES), "unknown_operation")
              .when(kind.isin("remove_assertion", "remove_entity_attribute", "set_unit_text",
                              "set_scene_omitted", "update_entity") & F.col("target_id").isNull(), "no_target")
              .when(adds & F.col("source_unit_id").isNull(), "missing_field")
              .when(adds, quality.signature_reason()))
    return operations.withColumn("refused", reason).filter("refused IS NOT NULL")


def accepted_only(operations: DataFrame) -> DataFrame:
    """Operations of change sets that apply whole."""
    bad = refused_operations(operations).select("change_set_id").distinct()
    return operations.join(bad, "change_set_id", "left_anti")


def apply_assertions(assertions: DataFrame, operations: DataFrame) -> DataFrame:
    """The assertion table after a batch of operations.

    Each operation becomes events on rows: (order, active, confidence). An edge
    that already has a row (same dedupe key) is that row again; a new edge gets
    an id hashed from its key, so the same batch applied twice changes nothing.
    """
    keyed = assertions.withColumn("dedupe_key", dedupe_key())
    kind = F.col("operation_type")
    adds = operations.filter(kind.isin("add_assertion", "update_assertion")
                             & F.col("source_unit_id").isNotNull()).withColumn(
        "dedupe_key", dedupe_key())
    # Only the keys that operations touch are looked up, not the whole table's.
    held = keyed.join(adds.select("script_id", "dedupe_key").distinct(), ["script_id", "dedupe_key"], "left_semi").groupBy(
        "script_id", "dedupe_key").agg(F.max_by("assertion_id", F.struct("active", "assertion_id")).alias("_row"))
    fields = ["script_id", "subject_kind", "subject_entity_id", "subject_scene_id", "predicate",
              "object_kind", "object_entity_id", "object_scene_id", "source_unit_id"]
    found = durable(adds.join(held, ["script_id", "dedupe_key"], "left").select(
        F.coalesce("_row", F.sha2(F.concat_ws("|", "script_id", "dedupe_key"), 256)).alias("assertion_id"),
        F.col("_row").isNull().alias("_new"), "accepted_order", "sequence_index", "confidence", *fields))
    rises = found.select("assertion_id", order().alias("at"), F.lit(1).alias("step"),
                         F.lit(True).alias("on"), "confidence")
    drops = operations.filter(kind.isin("remove_assertion", "update_assertion")
                              & F.col("target_id").isNotNull()).select(
        F.col("target_id").alias("assertion_id"), order().alias("at"), F.lit(0).alias("step"),
        F.lit(False).alias("on"), F.lit(None).cast("double").alias("confidence"))
    # Putting back a removed row needs no payload.
    back = operations.filter((kind == "add_assertion") & F.col("source_unit_id").isNull()
                             & F.col("target_id").isNotNull()).select(
        F.col("target_id").alias("assertion_id"), order().alias("at"), F.lit(1).alias("step"),
        F.lit(True).alias("on"), F.lit(None).cast("double").alias("confidence"))
    when = F.struct("at", "step")
    events = rises.unionByName(drops).unionByName(back).groupBy("assertion_id").agg(
        F.max_by("on", when).alias("_on"),
        F.max_by("confidence", F.when(F.col("confidence").isNotNull(), when)).alias("_conf"))
    old = keyed.drop("dedupe_key").join(events, "assertion_id", "left").withColumns({
        "active": F.coalesce("_on", "active"), "confidence": F.coalesce("_conf", "confidence")}
    ).drop("_on", "_conf")
    fresh = found.filter("_new").groupBy("assertion_id").agg(
        F.min_by(F.struct(*fields), order()).alias("e")).select("assertion_id", "e.*")
    fresh = fresh.join(events, "assertion_id").withColumns({"active": F.col("_on"),
                                                            "confidence": F.col("_conf")})
    return old.unionByName(fresh.select(*[c for c in old.columns if c in fresh.columns]),
                           allowMissingColumns=True)


def apply_texts(units: DataFrame, operations: DataFrame) -> DataFrame:
    """The last text set on each unit wins."""
    last = operations.filter("operation_type = 'set_unit_text'").groupBy(
        F.col("target_id").alias("unit_id")).agg(F.max_by("text", order()).alias("_text"),
                                                 F.count_distinct("change_set_id").alias("_n"))
    return units.join(last, "unit_id", "left").withColumns({
        "text": F.coalesce("_text", "text"),
        "current_version": F.col("current_version") + F.coalesce("_n", F.lit(0))}).drop("_text", "_n")


def apply_omissions(scenes: DataFrame, operations: DataFrame) -> DataFrame:
    last = operations.filter("operation_type = 'set_scene_omitted'").groupBy(
        F.col("target_id").alias("scene_id")).agg(F.max_by("omitted", order()).alias("_o"))
    return scenes.join(last, "scene_id", "left").withColumn(
        "omitted", F.coalesce("_o", "omitted")).drop("_o")


def apply_entities(entities: DataFrame, operations: DataFrame) -> DataFrame:
    """Create is idempotent on (script, type, name); describe keeps the last text."""
    made = operations.filter("operation_type = 'create_entity'").groupBy(
        "script_id", "entity_type", "normalized_name").agg(
        F.min_by("canonical_name", order()).alias("canonical_name"))
    key = ["script_id", "entity_type", "normalized_name"]
    fresh = made.join(entities.select(*key), key, "left_anti").withColumn(
        "entity_id", F.sha2(F.concat_ws("|", *key), 256))
    said = operations.filter("operation_type = 'update_entity' AND description IS NOT NULL").groupBy(
        F.col("target_id").alias("entity_id")).agg(F.max_by("description", order()).alias("_d"))
    both = entities.unionByName(fresh, allowMissingColumns=True)
    return both.join(said, "entity_id", "left").withColumn(
        "description", F.coalesce("_d", "description")).drop("_d")


def apply_attributes(attributes: DataFrame, operations: DataFrame,
                     hot_rows: int | None = None) -> DataFrame:
    """Attribute values with their history; setting the value in force is a no-op.

    Events of one (entity, key) are ordered; a set whose value differs from the
    one before it writes a row. The value before comes from a blocked scan.
    """
    key = ["entity_id", "key"]
    start = attributes.filter("active").select(
        *key, "value", "attribute_id", F.lit(0).cast("long").alias("accepted_order"),
        F.lit(-1).cast("long").alias("sequence_index"))
    sets = operations.filter("operation_type = 'set_entity_attribute'").select(
        *key, "value", F.sha2(F.concat_ws("|", "entity_id", "key", "value", "accepted_order",
                                          "sequence_index"), 256).alias("attribute_id"),
        "accepted_order", "sequence_index")
    cut = operations.filter("operation_type = 'remove_entity_attribute'").select(
        F.col("target_id").alias("attribute_id"), "accepted_order", "sequence_index").join(
        attributes.select("attribute_id", *key), "attribute_id").select(
        *key, F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("attribute_id"),
        "accepted_order", "sequence_index")
    events = start.unionByName(sets).unionByName(cut)
    by = [F.col("accepted_order"), F.col("sequence_index")]
    rows = scans.Scan(events, key, by, hot_rows).previous({"_before": F.col("value")}).done()
    written = rows.filter((F.col("sequence_index") < 0) | F.col("value").isNull()
                          | ~F.col("value").eqNullSafe(F.col("_before")))
    last = written.groupBy(*key).agg(F.max_by(F.struct("attribute_id"), F.struct(
        "accepted_order", "sequence_index")).alias("_l"))
    live = last.select(F.col("_l.attribute_id").alias("attribute_id"), F.lit(True).alias("_live"))
    fresh = written.filter("sequence_index >= 0 AND value IS NOT NULL").select(
        "attribute_id", *key, "value", F.lit(True).alias("active"))
    touched = operations.filter(F.col("operation_type").isin(
        "set_entity_attribute", "remove_entity_attribute")).select("entity_id", "key").distinct()
    both = attributes.unionByName(fresh, allowMissingColumns=True).join(
        live.filter("attribute_id IS NOT NULL"), "attribute_id", "left")
    changed = touched.filter("key IS NOT NULL").withColumn("_t", F.lit(True))
    return both.join(changed, key, "left").withColumn("active", F.when(
        F.col("_t") | F.col("_live").isNull(), F.coalesce("_live", F.lit(False))).otherwise(
        F.col("active"))).drop("_t", "_live")


def inverse_operations(operations: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """What undoes each change set: reversed order, sides swapped, types inverted."""
    pairs = [F.lit(x) for kv in vocab.INVERSE_OPERATIONS.items() for x in kv]
    fresh_set = (F.col("operation_type") == "set_entity_attribute") & F.col("before_json").isNull()
    inverse = F.when(fresh_set, "remove_entity_attribute").when(
        F.col("operation_type") == "set_entity_attribute", "set_entity_attribute").otherwise(
        F.create_map(*pairs)[F.col("operation_type")])
    last = operations.groupBy("change_set_id").agg(F.max("sequence_index").alias("_last"))
    return operations.join(last, "change_set_id").select(
        "change_set_id", (F.col("_last") - F.col("sequence_index")).alias("sequence_index"),
        inverse.alias("operation_type"), "target_type", "target_id",
        F.col("after_json").alias("before_json"), F.col("before_json").alias("after_json"))


def latest_accepted(change_sets: DataFrame, edited: DataFrame) -> DataFrame:
    """The newest accepted change of each unit, the only one that may be undone."""
    rows = edited.join(change_sets.filter("status = 'accepted'"), "change_set_id")
    return rows.groupBy("unit_id").agg(F.max_by("change_set_id", F.struct(
        "accepted_at", "change_set_id")).alias("change_set_id"))


def resolve_findings(findings: DataFrame, ended: DataFrame) -> DataFrame:
    """Open findings of a change set that was rejected or undone are resolved."""
    over = ended.select("change_set_id").distinct().withColumn("_over", F.lit(True))
    status = F.when(F.col("_over") & (F.col("status") == "open"), "resolved").otherwise(F.col("status"))
    return findings.join(over, "change_set_id", "left").withColumn("status", status).drop("_over")


def reject(change_sets: DataFrame, findings: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(change sets, findings) after decisions not to apply proposals.

    ``decided``: change_set_id, reason (or null). Only a pending proposal can be
    rejected. Its open findings are resolved, and a stated reason is kept as a
    resolved finding of its own.
    """
    pending = change_sets.filter("status = 'pending'").select("change_set_id")
    over = decided.join(pending, "change_set_id", "left_semi").groupBy("change_set_id").agg(F.max("reason").alias("reason"))
    hit = over.select("change_set_id", F.lit("rejected").alias("_s"))
    after = change_sets.join(hit, "change_set_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    notes = over.filter("reason <> ''").select(
        "change_set_id", F.lit("rejection_note").alias("finding_type"), F.lit("low").alias("severity"),
        F.col("reason").alias("message"), F.lit("resolved").alias("status"))
    return after, resolve_findings(findings, over).unionByName(notes, allowMissingColumns=True)


def undo(asked: DataFrame, change_sets: DataFrame, edited: DataFrame, operations: DataFrame, scripts: DataFrame,
         units: DataFrame, assertions: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """Every table after the latest accepted change of each asked unit is undone.

    ``asked``: unit_id. ``change_sets``: change_set_id, script_id, status, accepted_at.
    ``edited``: change_set_id, unit_id. ``operations`` as for inverse_operations; a text
    operation holds its texts as {"text": ...}. A change set named by several units is
    undone once. Undone sets become reverted, their open findings are resolved and the
    script's version rises by one per set. ``unrecorded`` lists sets left alone because
    one of their text operations kept no original text.
    """
    latest = latest_accepted(change_sets, edited.join(asked.select("unit_id").distinct(), "unit_id", "left_semi")).select(
        "change_set_id").distinct()
    old_text = F.get_json_object("before_json", "$.text")
    unrecorded = operations.filter((F.col("operation_type") == "set_unit_text") & old_text.isNull()).select(
        "change_set_id").distinct().join(latest, "change_set_id", "left_semi")
    undone = durable(latest.join(unrecorded, "change_set_id", "left_anti"))
    at = change_sets.select("change_set_id", F.struct("accepted_at", "change_set_id").alias("accepted_order"))
    inverse = inverse_operations(operations.join(undone, "change_set_id", "left_semi")).join(at, "change_set_id")
    text = inverse.filter("operation_type = 'set_unit_text'").withColumn("text", F.get_json_object("after_json", "$.text"))
    fields = [c for c in assertions.columns if c not in ("assertion_id", "active")]
    rows = inverse.filter("operation_type IN ('add_assertion', 'remove_assertion')").select(
        "*", *[F.lit(None).cast(assertions.schema[c].dataType).alias(c) for c in fields])
    over = undone.withColumn("_s", F.lit("reverted"))
    risen = change_sets.join(undone, "change_set_id", "left_semi").groupBy("script_id").agg(F.count(F.lit(1)).alias("_n"))
    return {
        "change_sets": change_sets.join(over, "change_set_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s"),
        "scripts": scripts.join(risen, "script_id", "left").withColumn(
            "current_version", F.col("current_version") + F.coalesce("_n", F.lit(0))).drop("_n"),
        "units": apply_texts(units, text), "assertions": apply_assertions(assertions, rows),
        "findings": resolve_findings(findings, undone), "unrecorded": unrecorded}


def proposal_print(edits: DataFrame) -> DataFrame:
    """What a proposal asks: a digest of its (unit, text, base version) set.

    The order-free digest is the count with the bitwise and arithmetic folds of a
    128-bit hash per edit, all combining, so a proposal of any size fits.
    """
    h = F.sha2(F.concat_ws("\x00", "unit_id", F.col("base_version").cast("string"), strip(F.col("text"))), 256)
    return edits.select("change_set_id", h.alias("h")).distinct().groupBy("change_set_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")).alias("x"),
        F.bit_xor(F.conv(F.substring("h", 16, 15), 16, 10).cast("long")).alias("y"),
        F.sum(F.conv(F.substring("h", 31, 12), 16, 10).cast("decimal(38,0)")).alias("z"))


def reusable(new_edits: DataFrame, old_edits: DataFrame, pending: DataFrame) -> DataFrame:
    """The newest pending proposal with a report that asks the same thing.

    ``pending``: change_set_id, script_id, base_script_version, created_at of
    old proposals; both edit frames carry script_id and base_script_version.
    """
    scope = ["script_id", "base_script_version"]
    key = [*scope, "n", "x", "y", "z"]

    def prints(edits):
        about = edits.groupBy("change_set_id").agg(*[F.max(c).alias(c) for c in scope])
        return proposal_print(edits).join(about, "change_set_id")
    old = prints(old_edits).join(pending.select("change_set_id", "created_at"), "change_set_id")
    newest = old.groupBy(*key).agg(F.max_by("change_set_id", F.struct("created_at", "change_set_id"))
                                   .alias("reuse_id"))
    return prints(new_edits).join(newest, key).select("change_set_id", "reuse_id")


def supersede(assertions: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Machine edges citing a rebuilt scene's units step down; people's stay.

    ``assertions`` carries unit_scene_id; ``rebuilt``: scene_id.
    """
    hit = rebuilt.select(F.col("scene_id").alias("unit_scene_id")).distinct().withColumn(
        "_r", F.lit(True))
    old = F.col("_r") & F.col("provenance").isin("model", "system")
    return assertions.join(hit, "unit_scene_id", "left").withColumn(
        "active", F.col("active") & ~F.coalesce(old, F.lit(False))).drop("_r")


def new_edges(proposed: DataFrame, assertions: DataFrame, key: list[str], rank: list[Column]) -> DataFrame:
    """Proposed rows whose active key is free; the first in scene order wins."""
    first = proposed.groupBy(*key).agg(F.min_by(F.struct(*[c for c in proposed.columns if c not in key]),
                                                F.struct(*rank)).alias("_p")).select(*key, "_p.*")
    return first.join(assertions.filter("active").select(*key), key, "left_anti")


def omission(assertions: DataFrame, scene_ids: DataFrame, dry_run: bool = False) -> DataFrame:
    """The active facts each omitted scene takes with it.

    The dry run looks only at cited units; the real omission also takes facts
    that name the scene at either end. ``assertions`` carries unit_scene_id.
    """
    live = assertions.filter("active")
    cols = ["unit_scene_id"] if dry_run else ["unit_scene_id", "subject_scene_id", "object_scene_id"]
    named = F.array_distinct(F.array_compact(F.array(*cols)))
    facts = live.withColumn("scene_id", F.explode(named))
    return facts.join(scene_ids.select("scene_id").distinct(), "scene_id", "left_semi")


def omission_operations(taken: DataFrame, scene_ids: DataFrame) -> DataFrame:
    """The operations of each omission: the flag first, then a removal per fact."""
    flags = scene_ids.select("scene_id", F.lit(0).alias("phase"), F.lit("set_scene_omitted")
                             .alias("operation_type"), F.col("scene_id").cast("string").alias("target_id"))
    cuts = taken.select("scene_id", F.lit(1).alias("phase"), F.lit("remove_assertion")
                        .alias("operation_type"), F.col("assertion_id").alias("target_id"))
    steps = durable(flags.unionByName(cuts))
    return scans.ordinal(steps, ["scene_id"], [F.col("phase"), F.col("target_id")], "_n").select(
        "scene_id", (F.col("_n") - 1).alias("sequence_index"), "operation_type", "target_id")


def restore_scenes(asked: DataFrame, scenes: DataFrame, change_sets: DataFrame, operations: DataFrame, assertions: DataFrame,
                   findings: DataFrame) -> dict[str, DataFrame]:
    """Every table after omitted scenes are put back by undoing their newest accepted omission.

    ``asked``: scene_id. ``scenes``: scene_id, omitted. ``change_sets``: change_set_id, kind,
    status, accepted_at. ``operations``: as for inverse_operations; the flag operation of an
    omission names its scene. The facts an omission removed are active again, the omission is
    reverted and its open findings are resolved. ``refused`` has the scenes left alone: not
    omitted, or without an accepted omission.
    """
    wanted = asked.select("scene_id").distinct().join(scenes.select("scene_id", "omitted"), "scene_id", "left")
    flags = operations.filter("operation_type = 'set_scene_omitted'").select(
        F.col("target_id").cast(scenes.schema["scene_id"].dataType).alias("scene_id"), "change_set_id")
    newest = flags.join(change_sets.filter("kind = 'omit_scene' AND status = 'accepted'"), "change_set_id").groupBy("scene_id").agg(
        F.max_by("change_set_id", F.struct("accepted_at", "change_set_id")).alias("change_set_id"))
    found = durable(wanted.join(newest, "scene_id", "left").withColumn(
        "reason", F.when(~F.coalesce("omitted", F.lit(False)), "not_omitted").when(F.col("change_set_id").isNull(), "no_omission")))
    back = found.filter("reason IS NULL")
    sets = back.select("change_set_id").distinct()
    inverse = durable(inverse_operations(operations.join(sets, "change_set_id", "left_semi")))
    facts = inverse.filter("operation_type = 'add_assertion'").select(
        F.col("target_id").alias("assertion_id"), F.lit(True).alias("_back")).distinct()
    shown = back.select("scene_id", F.lit(True).alias("_back"))
    over = sets.withColumn("_back", F.lit(True))
    return {
        "refused": found.filter("reason IS NOT NULL").select("scene_id", "reason"), "operations": inverse,
        "scenes": scenes.join(shown, "scene_id", "left").withColumn("omitted", F.col("omitted") & F.col("_back").isNull()).drop("_back"),
        "assertions": assertions.join(facts, "assertion_id", "left").withColumn(
            "active", F.col("active") | F.coalesce("_back", F.lit(False))).drop("_back"),
        "change_sets": change_sets.join(over, "change_set_id", "left").withColumn(
            "status", F.when(F.col("_back"), "reverted").otherwise(F.col("status"))).drop("_back"),
        "findings": resolve_findings(findings, sets)}


def insert_rows(rows: DataFrame, requests: DataFrame, key: str, unique: str, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the new ones in place, refused requests): scenes into scripts, or units into scenes.

    ``rows``: key, unique, sequence_index and more. ``requests``: request_id, key, after (a
    ``unique`` of the same key, null for the front), unique (of the new row) and more. Requests
    apply in their order, each right behind its anchor, so of several behind one anchor the
    last comes first. An anchor that the key does not hold refuses the request.
    """
    anchors = rows.select(F.col(key).alias("_key"), F.col(unique).alias("after"), F.col("sequence_index").alias("_at"))
    placed = requests.join(anchors, "after", "left")
    fits = F.col("after").isNull() | F.coalesce(F.col("_key") == F.col(key), F.lit(False))
    refused = placed.filter(~fits).select(*requests.columns)
    new = placed.filter(fits).withColumns({"_place": F.coalesce("_at", F.lit(-1)), "_turn": -F.col("request_id")})
    old = rows.withColumns({"_place": F.col("sequence_index"), "_turn": F.lit(None).cast("long")})
    both = old.unionByName(new.select(*[c for c in old.columns if c in new.columns]), allowMissingColumns=True)
    order = [F.col("_place"), F.col("_turn").asc_nulls_first()]
    numbered = scans.ordinal(durable(both), [key], order, "_n", hot_rows)
    return numbered.withColumn("sequence_index", F.col("_n") - 1).drop("_n", "_place", "_turn"), refused


def resequence(rows: DataFrame, keys: list[str], place: str, unique: str,
               hot_rows: int | None = None) -> DataFrame:
    """Positions closed up after insertions (fractional places) and deletions."""
    ordered = scans.ordinal(rows, keys, [F.col(place), F.col(unique)], "_n", hot_rows)
    return ordered.withColumn("sequence_index", F.col("_n") - 1).drop("_n")


def deletable(units: DataFrame, wanted: DataFrame, citing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units left, refused ids): a cited unit stays; lineage to a deleted one is cleared."""
    cited = citing.select(F.col("source_unit_id").alias("unit_id")).distinct()
    refused = wanted.join(cited, "unit_id", "left_semi")
    gone = wanted.join(cited, "unit_id", "left_anti").select("unit_id").distinct()
    left = units.join(gone, "unit_id", "left_anti")
    dead = gone.select(F.col("unit_id").alias("predecessor_unit_id"), F.lit(True).alias("_dead"))
    left = left.join(dead, "predecessor_unit_id", "left").withColumn(
        "predecessor_unit_id", F.when(F.col("_dead").isNull(), F.col("predecessor_unit_id"))).drop("_dead")
    return left, refused


def bulk_active(assertions: DataFrame, wanted: DataFrame, on: bool) -> DataFrame:
    """Deactivate, or reactivate where no other active row holds the key.

    Of several wanted rows with one key the lowest id is brought back.
    """
    chosen = assertions.join(wanted.select("assertion_id").distinct(), "assertion_id", "left_semi")
    if on:
        free = chosen.filter(~F.col("active")).join(
            assertions.filter("active").select("dedupe_key"), "dedupe_key", "left_anti")
        chosen = free.groupBy("dedupe_key").agg(F.min("assertion_id").alias("assertion_id"))
    hit = chosen.select("assertion_id", F.lit(True).alias("_hit"))
    return assertions.join(hit, "assertion_id", "left").withColumn(
        "active", F.when(F.col("_hit"), F.lit(on)).otherwise(F.col("active"))).drop("_hit")


def cleared(tables: dict[str, DataFrame], scripts: DataFrame,
            keep: tuple[str, ...] = ("scripts", "scenes", "units")) -> dict[str, DataFrame]:
    """Every dependent table without the scripts' rows; the text side stays.

    With ``keep=()`` the scripts themselves go too. Each frame carries script_id.
    """
    gone = scripts.select("script_id").distinct()
    return {name: frame if name in keep else frame.join(gone, "script_id", "left_anti")
            for name, frame in tables.items()}


def text_saves(saves: DataFrame, units: DataFrame, citing: DataFrame) -> DataFrame:
    """What each direct save does: saved, unchanged, or why it is refused.

    Blank runs collapse; a line an active fact cites is edited through a proposal.
    """
    clean = strip(F.regexp_replace("new_text", r"(?U)[\s\x1c-\x1f]+", " "))
    cited = citing.select(F.col("source_unit_id").alias("unit_id"), F.lit(True).alias("_cited")).distinct()
    rows = saves.withColumn("clean", clean).join(units.select("unit_id", "text"), "unit_id", "left").join(
        cited, "unit_id", "left")
    state = (F.when(F.col("text").isNull(), "no_unit").when(F.col("clean") == "", "empty")
             .when(F.col("clean") == F.col("text"), "unchanged").when(F.col("_cited"), "cited")
             .otherwise("saved"))
    return rows.withColumn("state", state).drop("_cited")


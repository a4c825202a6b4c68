"""Grouped results over the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions import figures
from plotline.operators.filters import first_in


def counts_with_zero(owners: DataFrame, key: str, **frames: DataFrame) -> DataFrame:
    """A1: rows per owner in each frame; owners with none read zero."""
    for name, frame in frames.items():
        owners = owners.join(frame.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return owners.na.fill(0, list(frames))


def pages_per_script(units: DataFrame) -> DataFrame:
    """A3: the largest source page, else an estimate from length."""
    sums = units.groupBy("script_id").agg(F.max("page_number").alias("_page"),
                                          F.sum(F.char_length("text")).alias("_chars"))
    counted = F.when(F.col("_page") > 0, F.col("_page"))
    return sums.select("script_id", F.coalesce(counted.cast("long"), figures.pages(
        F.coalesce("_chars", F.lit(0)))).alias("pages"))


def roster(entities: DataFrame, keys: list[str], cap: int = vocab.ROSTER_NAME_CAP) -> DataFrame:
    """A5: the true count per department and the first names in order.

    The cap is the roster's own definition. The count is taken over all rows;
    names are limited per partition before they shuffle.
    """
    totals = entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    named = first_in(entities, keys, [F.col("canonical_name"), F.col("entity_id")], cap)
    lists = named.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "canonical_name"))),
        lambda x: x["canonical_name"]).alias("names"))
    return totals.join(lists, keys)


def counters(**frames: tuple[DataFrame, Column | None]) -> DataFrame:
    """One conditional count per named frame."""
    out = None
    for name, (frame, test) in frames.items():
        n = F.count(F.lit(1)) if test is None else F.count_if(test)
        row = frame.agg(F.lit(name).alias("counter"), n.alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def deletion_preview(scripts: DataFrame, owned: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A10: rows per table that deleting each script would remove.

    ``owned`` maps a table to (frame, key); the frame already carries the
    script (findings reach it through their change set).
    """
    out = None
    for table, (frame, key) in owned.items():
        rows = (frame.join(scripts.select(F.col("script_id").alias(key)), key, "left_semi")
                .groupBy(F.col(key).alias("script_id"))
                .agg(F.lit(table).alias("table"), F.count(F.lit(1)).alias("n")))
        out = rows if out is None else out.unionByName(rows)
    return out


def coverage(cited: DataFrame, wanted: Column) -> DataFrame:
    """Scenes citing a thing; distinct (unit, predicate, line) in each.

    ``cited``: keys, scene, subject_label, object_label, unit_id, predicate, line.
    """
    hit = F.contains(F.lower("subject_label"), wanted) | F.contains(F.lower("object_label"), wanted)
    return (cited.filter(hit).select("wanted", "scene", "unit_id", "predicate", "line").distinct()
            .groupBy("wanted", "scene").agg(
                F.count(F.lit(1)).alias("units"), F.count_distinct("predicate").alias("predicates"),
                F.min("unit_id").alias("first_unit")))


# What each operation did to a scene, in the words of the summary.
APPLIED_LABELS = {
    "set_unit_text": "Text rewritten", "set_scene_omitted": "Scene omitted",
    "create_entity": "Entity created", "update_entity": "Entity updated",
    "set_entity_attribute": "Attribute set", "remove_entity_attribute": "Attribute removed"}


def applied_summary(operations: DataFrame) -> DataFrame:
    """What each change set did, scene by scene.

    ``operations``: change_set_id, operation_type, scene (label), predicate. The
    sets hold at most six labels and nine predicates.
    """
    label = F.create_map(*[F.lit(x) for kv in APPLIED_LABELS.items() for x in kv])
    grouped = operations.groupBy("change_set_id", F.coalesce("scene", F.lit("—")).alias("scene")).agg(
        F.count(F.lit(1)).alias("operations"),
        F.array_join(F.array_sort(F.collect_set(label[F.col("operation_type")])), ", ").alias("_a"),
        F.array_join(F.array_sort(F.collect_set(F.upper("predicate"))), ", ").alias("predicate"))
    return grouped.withColumn("applied", F.coalesce(F.nullif("_a", F.lit("")),
                                                    F.lit("Graph updated"))).drop("_a")


def likeness(scenes: DataFrame, units: DataFrame) -> DataFrame:
    """How much a parse result looks like a screenplay, and why not.

    ``scenes``: doc_id. ``units``: doc_id, unit_type, text. One combined
    aggregate per document on each side.
    """
    kind = F.col("unit_type")
    action = F.when(kind == "action", F.char_length("text"))
    seen = units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("units"), F.count_if(kind == "character").alias("cues"),
        F.count_if(kind == "dialogue").alias("speech"), F.avg(action).alias("mean_action"))
    rows = scenes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("scenes")).join(seen, "doc_id", "left")
    many = F.col("scenes") >= 3
    talks = (F.coalesce("cues", F.lit(0)) > 0) & (F.coalesce("speech", F.lit(0)) > 0)
    share = F.coalesce(F.col("speech") / F.col("units"), F.lit(0.0))
    terse = F.coalesce(F.col("mean_action") <= 700, F.lit(False))

    def gain(test, points):
        return F.when(test, points).otherwise(0)
    score = (gain(many, 35) + gain(talks, 35) + gain(share >= 0.08, 20) + gain(terse, 10)) / 100
    reasons = F.array_compact(F.array(
        F.when(~many, "few_scenes"), F.when(~talks, "no_speech"),
        F.when(share < 0.08, "little_dialogue"), F.when(F.col("mean_action") > 700, "long_action")))
    empty = F.col("units").isNull()
    return rows.select(
        "doc_id", "scenes", F.coalesce("units", F.lit(0)).alias("units"),
        F.when(empty, 0.0).otherwise(F.round(score, 2)).alias("score"),
        (~empty & (score >= 0.5)).alias("is_screenplay"),
        (~empty & (score >= 0.5) & (score < 0.6)).alias("needs_review"),
        F.when(empty, F.array(F.lit("no_content"))).otherwise(reasons).alias("reasons"))


def draft_kinds(scenes: DataFrame, key: str = "script_id") -> DataFrame:
    """Scenes per lineage kind, one row per script."""
    kinds = ["unchanged", "modified", "inserted", "deleted"]
    return (scenes.groupBy(key).pivot("lineage_kind", kinds).count().na.fill(0, kinds))


def severity(diff: DataFrame, later: DataFrame, lifted: DataFrame | None = None) -> DataFrame:
    """High, medium, low or none per change set.

    ``diff``: change_set_id, state. ``later``: change sets whose findings cite
    later lines. ``lifted``: change sets with an attribute change or a rename.
    """
    weight = (F.when(F.col("state").isin("removed", "changed"), 2)
              .when(F.col("state") == "added", 1).otherwise(0))
    rows = diff.select("change_set_id", weight.alias("w"))
    rows = rows.unionByName(later.select("change_set_id", F.lit(3).alias("w")))
    if lifted is not None:
        rows = rows.unionByName(lifted.select("change_set_id", F.lit(2).alias("w")))
    name = F.element_at(F.array(*[F.lit(s) for s in ("none", "low", "medium", "high")]),
                        F.max("w") + 1)
    return rows.groupBy("change_set_id").agg(name.alias("severity"))


def open_findings(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Open findings per script and the distinct lines they flag."""
    open_rows = findings.filter("status = 'open'")
    counts = open_rows.groupBy("script_id").agg(F.count(F.lit(1)).alias("open"))
    flagged = (open_rows.join(evidence.filter("unit_id IS NOT NULL"), "finding_id")
               .select("script_id", "unit_id").distinct()
               .groupBy("script_id").agg(F.count(F.lit(1)).alias("flagged_units")))
    return counts.join(flagged, "script_id", "left").na.fill(0, ["flagged_units"])


def facts_citing(assertions: DataFrame, attributes: DataFrame) -> DataFrame:
    """Active facts of either kind per cited unit."""
    rows = assertions.filter("active").select("source_unit_id").unionByName(
        attributes.filter("active AND source_unit_id IS NOT NULL").select("source_unit_id"))
    return rows.groupBy("source_unit_id").agg(F.count(F.lit(1)).alias("facts"))


def is_bare_cue(text: Column) -> Column:
    t = F.btrim(text)
    return (t != "") & ~F.contains(t, F.lit(" ")) & (t == F.upper(t)) & t.rlike(r"\p{L}")


def grounding(matched: DataFrame, key: str, sample: int = 6) -> tuple[DataFrame, DataFrame]:
    """(metrics per question, the sampled units).

    ``matched``: key, item_rank, unit_id, unit_text, predicate, subject_label,
    object_label, confidence, asks_presence. Bare cues and presence edges are
    shown only when nothing more substantial is cited.
    """
    metrics = matched.groupBy(key).agg(
        F.count(F.lit(1)).alias("grounded_in"), F.count_distinct("unit_id").alias("total_units"),
        F.round(F.avg("confidence"), 2).alias("mean_confidence"))
    names = matched.select(key, F.explode(F.array("subject_label", "object_label")).alias("name")
                           ).distinct()
    first_names = first_in(names, [key], [F.col("name")], 8).groupBy(key).agg(
        F.array_sort(F.collect_list("name")).alias("entities"))
    presence = (F.col("predicate").isin(*vocab.PRESENCE_PREDICATES) & ~F.col("asks_presence"))
    once = matched.groupBy(key, "unit_id").agg(F.min_by(
        F.struct("item_rank", "unit_text", (presence | is_bare_cue(F.col("unit_text"))).alias("held")),
        "item_rank").alias("u")).select(key, "unit_id", "u.*")
    any_real = once.groupBy(key).agg(F.bool_or(~F.col("held")).alias("_real"))
    shown = once.join(any_real, key).filter(~F.col("held") | ~F.col("_real"))
    cited = first_in(shown.drop("_real"), [key], [F.col("item_rank")], sample, "place")
    return metrics.join(first_names, key), cited


def first_seen(rows: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Each distinct label with where it was first seen.

    Rows, not one array: the number of labels in a group has no bound.
    """
    return rows.groupBy(*keys, label).agg(F.min(order).alias("first_at"))


def validation_tally(items: DataFrame, key: str = "call_id") -> DataFrame:
    """Kept and rejected items per call with the reasons, sorted."""
    kept = F.col("reason").isNull()
    return items.groupBy(key).agg(
        F.count_if(kept & (F.col("what") == "entity")).alias("entities"),
        F.count_if(kept & (F.col("what") == "assertion")).alias("assertions"),
        F.count_if(~kept).alias("rejected"),
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))



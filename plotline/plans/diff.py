"""The difference of two edge sets, and the operations that carry it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.words import first_endpoint, second_endpoint
from plotline.operators import scans
from plotline.session import durable

IDENTITY = ["subject_kind", "subject_key", "predicate", "object_kind", "object_key"]
SLOT = ["subject_kind", "subject_key", "predicate", "object_kind", "object_type"]
CARRIED = ["subject_type", "object_type", "confidence", "source_unit_id", "assertion_id", "manner"]


def endpoint_key(kind: Column, ref: Column, entity_type: Column) -> Column:
    """A scene is its id; an entity is its type and normalized name."""
    return F.when(kind == "entity", F.concat_ws(":", entity_type, ref)).otherwise(ref)


def canonical(edges: DataFrame) -> DataFrame:
    """Symmetric edges with their endpoints in one order, types along with them."""
    p, s, o = F.col("predicate"), F.col("subject_key"), F.col("object_key")
    swapped = first_endpoint(p, s, o) != s
    return edges.withColumns({
        "subject_key": first_endpoint(p, s, o), "object_key": second_endpoint(p, s, o),
        "subject_type": F.when(swapped, F.col("object_type")).otherwise(F.col("subject_type")),
        "object_type": F.when(swapped, F.col("subject_type")).otherwise(F.col("object_type"))})


def _merged(rows: DataFrame, batch: str) -> DataFrame:
    """One row an identity, with its last edge on each side (``position`` orders them) and its state."""
    at = lambda held: F.max_by("edge", F.when(held, F.col("position")))
    both = rows.groupBy(batch, *IDENTITY, "_apart").agg(at(F.col("_old")).alias("before"), at(~F.col("_old")).alias("after")).drop("_apart")
    return both.withColumn("state", F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").otherwise(
        "unchanged")).withColumn("object_type", F.coalesce("before.object_type", "after.object_type"))


def diff_edges(accepted: DataFrame, proposed: DataFrame, batch: str = "change_set_id", hot_rows: int | None = None) -> DataFrame:
    """G1: every edge once, as unchanged, removed, added or changed.

    A removal and an addition become one change only where their slot holds
    exactly one of each. Rows are dealt by change set once, and a change set is
    merged and its slots are paired where they then are. Change sets of more than
    ``hot_rows`` rows are merged by identity and their slots counted with a
    combining aggregate that also yields the pair, so no such edges are gathered.
    """
    def side(edges: DataFrame, old: bool) -> DataFrame:
        return canonical(edges).select(batch, *IDENTITY, "position", F.struct(*CARRIED).alias("edge"), F.lit(old).alias("_old"))
    rows = side(accepted, True).unionByName(side(proposed, False))
    # A null in an identity equals nothing, so such edges stay apart by side.
    unnamed = F.lit(False)
    for c in [batch, *IDENTITY]:
        unnamed = unnamed | F.col(c).isNull()
    rows = rows.withColumn("_apart", F.when(unnamed, F.col("_old")))
    limit = scans.HOT_ROWS if hot_rows is None else hot_rows
    sizes = accepted.select(batch).unionByName(proposed.select(batch)).groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    hot = durable(sizes.filter(F.col("_n") > limit).select(F.col(batch).alias("_hot")))
    if hot.isEmpty():
        return _paired_in_place(rows, batch)
    is_hot = rows[batch].eqNullSafe(hot["_hot"])
    return _paired_in_place(rows.join(F.broadcast(hot), is_hot, "left_anti"), batch).unionByName(
        _paired_by_aggregate(rows.join(F.broadcast(hot), is_hot, "left_semi"), batch))


def _paired_in_place(rows: DataFrame, batch: str) -> DataFrame:
    """The diff of change sets each of which fits a task."""
    both = _merged(rows.repartition(batch), batch)
    removed, added = F.col("state") == "removed", F.col("state") == "added"
    slot = Window.partitionBy(batch, *SLOT[:4], F.coalesce("object_type", F.lit("")))
    seen = both.withColumns({
        "_pair": (F.count_if(removed).over(slot) == 1) & (F.count_if(added).over(slot) == 1),
        "_new": F.max(F.when(added, F.struct("object_key", "after"))).over(slot)})
    changed = F.col("_pair") & removed
    return seen.filter(~(F.col("_pair") & added)).withColumns({
        "object_type": F.when(F.col("state") == "unchanged", F.col("object_type")).otherwise(F.coalesce("object_type", F.lit(""))),
        "after": F.when(changed, F.col("_new.after")).otherwise(F.col("after")),
        "state": F.when(changed, "changed").otherwise(F.col("state")),
        "new_object_key": F.when(changed, F.col("_new.object_key"))}).drop("_pair", "_new")


def _paired_by_aggregate(rows: DataFrame, batch: str) -> DataFrame:
    """The diff of change sets of any size."""
    both = durable(_merged(rows, batch))
    moved = both.filter("state <> 'unchanged'")
    removed, added = F.col("state") == "removed", F.col("state") == "added"
    slot = [F.col(c) if c != "object_type" else F.coalesce("object_type", F.lit("")).alias("object_type")
            for c in SLOT]
    keyed = moved.select(batch, *slot, "object_key", "before", "after", "state")
    pairs = keyed.groupBy(batch, *SLOT).agg(
        F.count_if(removed).alias("r"), F.count_if(added).alias("a"),
        F.max(F.when(removed, F.struct("object_key", "before"))).alias("old"),
        F.max(F.when(added, F.struct("object_key", "after"))).alias("new")).filter("r = 1 AND a = 1")
    changed = pairs.select(
        batch, *SLOT[:4], F.col("old.object_key").alias("object_key"),
        F.col("old.before").alias("before"), F.col("new.after").alias("after"),
        F.col("object_type"), F.col("new.object_key").alias("new_object_key"),
        F.lit("changed").alias("state"))
    taken = pairs.select(*[F.col(c).alias(f"_{c}") for c in [batch, *SLOT]])
    rest = moved.withColumn("object_type", F.coalesce("object_type", F.lit("")))
    rest = rest.join(taken, scans.null_safe(rest, taken, {c: f"_{c}" for c in [batch, *SLOT]}), "left_anti")
    same = both.filter("state = 'unchanged'")
    return same.unionByName(rest).withColumn("new_object_key", F.lit(None).cast("string")).unionByName(
        changed)


def payload(key: str, edge: str) -> Column:
    """A snapshot from which the edge can be validated and rebuilt."""
    return F.struct(
        "subject_kind", F.col("subject_key").alias("subject_ref"),
        F.col(f"{edge}.subject_type").alias("subject_entity_type"), "predicate", "object_kind",
        F.col(key).alias("object_ref"), F.col(f"{edge}.object_type").alias("object_entity_type"),
        F.col(f"{edge}.confidence").alias("confidence"),
        F.col(f"{edge}.source_unit_id").alias("source_unit_id"),
        F.col(f"{edge}.assertion_id").alias("assertion_id"), F.col(f"{edge}.manner").alias("manner"))


def to_operations(diff: DataFrame, batch: str = "change_set_id",
                  hot_rows: int | None = None) -> DataFrame:
    """Removals, then updates, then additions, each numbered within its change set.

    ``diff`` is read twice, so a caller writes it first.
    """
    steps = diff.filter("state <> 'unchanged'").withColumns({
        "phase": F.when(F.col("state") == "removed", 0).when(F.col("state") == "changed", 1).otherwise(2),
        "operation_type": F.when(F.col("state") == "removed", "remove_assertion")
        .when(F.col("state") == "changed", "update_assertion").otherwise("add_assertion")})
    order = [F.col("phase"), *[F.col(c) for c in IDENTITY]]
    numbered = scans.ordinal(steps, [batch], order, "_n", hot_rows)
    new_key = F.coalesce("new_object_key", "object_key")
    numbered = numbered.withColumn("_new_key", new_key)
    return numbered.select(
        batch, (F.col("_n") - 1).alias("sequence_index"), "operation_type",
        F.lit("assertion").alias("target_type"),
        F.when(F.col("before").isNotNull(), F.col("before.assertion_id")).alias("target_id"),
        F.when(F.col("before").isNotNull(), F.to_json(payload("object_key", "before"))).alias("before_json"),
        F.when(F.col("after").isNotNull(), F.to_json(payload("_new_key", "after"))).alias("after_json"))

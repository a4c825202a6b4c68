"""Carried values, islands, lookahead retyping, evidence windows.

Scenes may have any number of units: everything that looks along a scene goes through
``scans.Scan``, which cuts long ones into blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import vocab
from plotline.operators.scans import Scan


def by_scene(units: DataFrame, hot_rows: int | None = None) -> Scan:
    return Scan(units, ["scene_id"], [F.col("sequence_index")], hot_rows)


def carried(units: DataFrame, name: str, value: Column, hot_rows: int | None = None) -> DataFrame:
    """The last value seen so far."""
    return by_scene(units, hot_rows).last_seen(name, value).done()


def join_wrapped(units: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Consecutive wrapped lines of one type and speaker become one unit.

    The lines of a run are joined within their block first, so no task holds more of a
    scene than one block or one joined unit.
    """
    wraps = F.col("unit_type").isin("dialogue", "action")
    scan = by_scene(units, hot_rows).previous({"_type": F.col("unit_type"), "_speaker": F.col("speaker")})
    same = wraps & (F.col("_type") == F.col("unit_type")) & F.col("_speaker").eqNullSafe(F.col("speaker"))
    scan = scan.total("run", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1), inclusive=True)

    def joined(rows: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", rows))), lambda u: u[rows]), " ")
    rows = scan.frame
    if scan.cut:
        rows = rows.groupBy("scene_id", "run", "_block").agg(
            F.min("sequence_index").alias("sequence_index"), F.min_by("unit_type", "sequence_index").alias("unit_type"),
            joined("text").alias("text"), F.count(F.lit(1)).alias("_lines"))
    else:
        rows = rows.withColumn("_lines", F.lit(1))
    return rows.groupBy("scene_id", "run").agg(
        F.min("sequence_index").alias("sequence_index"), F.min_by("unit_type", "sequence_index").alias("unit_type"),
        joined("text").alias("text"), F.sum("_lines").alias("lines"))


def latest(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The newest row per key, as a combining aggregate."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_r")).select(
        *keys, "_r.*")


def earliest(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_r")).select(
        *keys, "_r.*")


def settle_cues(units: DataFrame, cited: DataFrame, include_last: bool = False, hot_rows: int | None = None) -> DataFrame:
    """A cue no speech follows becomes action, unless a fact cites it.

    ``cited``: unit_id. The last cue of a scene is left while it may still be
    answered, and settled with ``include_last``.
    """
    rows = by_scene(units, hot_rows).following({"_follows": F.col("unit_type")}).done()
    silent = (F.col("unit_type") == "character") & F.when(
        F.col("_follows").isNull(), F.lit(include_last)).otherwise(
        ~F.col("_follows").isin("dialogue", "parenthetical"))
    marked = rows.withColumn("_silent", silent).join(
        cited.select("unit_id").distinct().withColumn("_cited", F.lit(True)), "unit_id", "left")
    demoted = F.col("_silent") & F.col("_cited").isNull()
    return (marked.withColumn("demoted", demoted)
            .withColumn("unit_type", F.when(demoted, "action").otherwise(F.col("unit_type")))
            .withColumn("speaker", F.when(~demoted, F.col("speaker"))).drop("_silent", "_cited", "_follows"))


def speaker_above(units: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Who a line placed after each unit would belong to."""
    kind = F.col("unit_type")
    named = (F.when(kind == "character", F.coalesce("speaker", "text"))
             .when(kind.isin("dialogue", "parenthetical"), F.col("speaker")))
    return carried(units, "speaker_above", named, hot_rows)


def context_window(units: DataFrame, match: Column, around: int = 2, cap: int = 80, hot_rows: int | None = None) -> DataFrame:
    """Matching lines with their neighbours, or the opening lines of the scene.

    A scene of at most ``cap`` lines is returned whole. The cap is the window's own
    definition; ``total`` is the number of lines it chose from, so ``total`` over ``cap``
    says that some were left out. A line is near a match when the last match up to it or the
    next one from it is at most ``around`` lines away.
    """
    scan = by_scene(units.withColumn("_hit", F.coalesce(match, F.lit(False))), hot_rows).ordinal("_at")
    scan.of_key({"_n": (F.count(F.lit(1)), F.sum), "_any": (F.max("_hit"), F.max)})
    at = F.when(F.col("_hit"), F.col("_at"))
    scan.last_seen("_above", at).next_seen("_below", at)
    near = (F.coalesce(F.col("_at") - F.col("_above") <= around, F.lit(False))
            | F.coalesce(F.col("_below") - F.col("_at") <= around, F.lit(False)))
    scan.add({"_kept": (F.col("_n") <= cap) | near | ~F.col("_any")})
    scan.ordinal("_k", F.col("_kept")).of_key({"total": (F.count_if("_kept"), F.sum)})
    return scan.done().filter(F.col("_kept") & (F.col("_k") <= cap)).drop("_hit", "_at", "_n", "_any", "_above", "_below", "_kept", "_k")


def first_text(operations: DataFrame) -> DataFrame:
    """The text a unit held before its earliest accepted edit; undo is no edit."""
    edits = operations.filter((F.col("kind") != "undo")
                              & (F.col("operation_type") == "set_unit_text"))
    return edits.groupBy("unit_id").agg(
        F.min_by("before_text", F.struct("created_at", "sequence_index")).alias("original_text"))


def read_windows(units: DataFrame, size: int = vocab.UNITS_PER_WINDOW, hot_rows: int | None = None) -> DataFrame:
    """The reading window of each unit, and the id prefix items of it take."""
    rows = by_scene(units, hot_rows).ordinal("_at").done()
    k = F.floor((F.col("_at") - 1) / size)
    return rows.withColumn("window", k).withColumn(
        "id_prefix", F.when(k > 0, F.concat(F.lit("w"), k, F.lit(":"))).otherwise("")).drop("_at")

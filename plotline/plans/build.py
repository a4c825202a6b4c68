"""Content hashes, work lists and run progress of a graph build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.ledger import priced, zero
from plotline.operators.streamed import digests

CACHE_KEY = ["scene_id", "input_hash", "prompt_version", "model_id"]


def scene_hash(scenes: DataFrame, units: DataFrame, fingerprint: str) -> DataFrame:
    """SHA-256 over the fingerprint, the heading, and every unit's type and text.

    The hash is streamed along each scene, whatever its length; it is null where the heading
    is. A unit without a type or text adds nothing.
    """
    nul = F.lit("\x00")
    none = F.lit(None).cast("string")
    opening = scenes.select("scene_id", F.lit(None).cast(units.schema["sequence_index"].dataType).alias("sequence_index"),
                            none.alias("unit_type"), F.concat(F.lit(fingerprint), nul, "heading").alias("_piece"))
    body = units.select("scene_id", "sequence_index", "unit_type", F.concat(nul, "unit_type", nul, "text").alias("_piece"))
    rows = opening.withColumn("_side", F.lit(0)).unionByName(body.withColumn("_side", F.lit(1)))
    order = [F.col("_side"), F.col("sequence_index"), F.col("_piece")]
    found = digests(rows, "scene_id", order, F.col("_piece"), "_hash")
    return scenes.join(found, "scene_id", "left").withColumn(
        "input_hash", F.when(F.col("heading").isNotNull(), F.col("_hash"))).drop("_hash")


def pending_scenes(scenes: DataFrame, cache: DataFrame, prompt_version: str,
                   model_id: str, force: bool = False) -> DataFrame:
    """Scenes in play whose content no completed read covers."""
    wanted = scenes.filter(~F.col("omitted")).withColumn(
        "prompt_version", F.lit(prompt_version)).withColumn("model_id", F.lit(model_id))
    if force:
        return wanted
    done = cache.filter("status = 'completed'").select(*CACHE_KEY)
    return wanted.join(done, CACHE_KEY, "left_anti")


def drop_unfinished(cache: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows a new run replaces: unfinished ones with the key of a new job."""
    stale = cache.filter("status <> 'completed'").join(jobs.select(*CACHE_KEY), CACHE_KEY,
                                                       "left_semi")
    return cache.join(stale.select("extraction_id"), "extraction_id", "left_anti")


def cancel(cache: DataFrame, cancelled_runs: DataFrame) -> DataFrame:
    """A cancelled run loses the jobs nobody has started."""
    gone = (cache.filter("status = 'pending'")
            .join(cancelled_runs.select("run_id"), "run_id", "left_semi"))
    return cache.join(gone.select("extraction_id"), "extraction_id", "left_anti")


def run_status(total: Column, completed: Column, failed: Column, open_jobs: Column,
               current: Column) -> Column:
    """A run's status from its scenes; cancelled is final."""
    return (F.when(current == "cancelled", current)
            .when(open_jobs > 0, F.when(completed > 0, "partially_ready").otherwise("running"))
            .when(failed > 0, F.when(completed > 0, "partially_ready").otherwise("failed"))
            .otherwise("ready"))


def roll_up(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    counts = jobs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_scenes"),
        F.count_if(F.col("status") == "completed").alias("completed_scenes"),
        F.count_if(F.col("status") == "failed").alias("failed_scenes"),
        F.count_if(F.col("status").isin("pending", "running")).alias("open_scenes"))
    joined = runs.join(counts, "run_id", "left").na.fill(
        0, ["total_scenes", "completed_scenes", "failed_scenes", "open_scenes"])
    return joined.withColumn("new_status", run_status(
        F.col("total_scenes"), F.col("completed_scenes"), F.col("failed_scenes"),
        F.col("open_scenes"), F.col("status")))


def progress(runs: DataFrame, calls: DataFrame, rates: DataFrame, written: DataFrame) -> DataFrame:
    """What each run has put in the graph and spent since it started.

    ``runs``: run_id, script_id, started_at. ``written``: run_id, one row per
    assertion a run wrote. Reads of the run's script made before it are not its own.
    """
    reads = priced(calls.filter("purpose = 'extract'"), rates).join(runs, "script_id").filter(
        F.col("created_at") >= F.col("started_at"))
    spent = reads.groupBy("run_id").agg(
        F.sum(zero("input_tokens") + zero("output_tokens") + zero("reasoning_tokens")).alias("tokens"),
        F.sum("cost").alias("cost"))
    graph = written.groupBy("run_id").agg(F.count(F.lit(1)).alias("assertions"))
    return runs.join(spent, "run_id", "left").join(graph, "run_id", "left").na.fill(
        0, ["tokens", "cost", "assertions"])


def stamp(before: DataFrame, after: DataFrame, cache: DataFrame, prompt_version: str,
          model_id: str) -> DataFrame:
    """Cache rows an accepted edit earns.

    A scene is stamped only when its content before the edit had been read, and
    its content after the edit has not. Both frames carry scene_id, input_hash.
    """
    key = [F.lit(prompt_version).alias("prompt_version"), F.lit(model_id).alias("model_id")]
    done = cache.filter("status = 'completed'").select(*CACHE_KEY)
    read = (before.filter(~F.col("omitted")).select("scene_id", "input_hash", *key)
            .join(done, CACHE_KEY, "left_semi").select("scene_id"))
    return (after.join(read, "scene_id", "left_semi").select("scene_id", "input_hash", *key)
            .join(done, CACHE_KEY, "left_anti").distinct())

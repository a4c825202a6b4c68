"""The event-driven jobs as Structured Streaming.

Outputs go through Spark's file sink or are keyed by batch id and written whole, so a batch
that is replayed after a failure replaces its own; checkpoints live in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from plotline import vocab
from plotline.operators.ledger import zero
from plotline.plans import build, rules
from plotline.session import durable, new_folder  # noqa: F401
from plotline.streaming.store import Store


def read_stream(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """New files of one table, as they appear; the table is one file or a folder of parts.

    Spark takes a plain path for a folder, so the name is given as a pattern that only it matches.
    """
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
            .parquet(f"{folder}/[{table[0]}]{table[1:]}.parquet"))


def to_parquet(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").option("path", folder)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def first_copies(payloads: DataFrame, seen: DataFrame, at: str, delay: str) -> DataFrame:
    """Payloads whose bytes were not imported before.

    Only the hash, the id and the time are shuffled; the bytes stay where they
    were read. Older twins leave through a join with the static import table.
    """
    narrow = payloads.select("import_id", at, F.sha2("content", 256).alias("content_hash"))
    once = narrow.withWatermark(at, delay).dropDuplicatesWithinWatermark(["content_hash"])
    return once.join(seen.select("content_hash").distinct(), "content_hash", "left_anti")


def burst_ledger(calls: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Bursts of calls as session windows; a gap of exactly 20 minutes stays inside.

    With session.SETTINGS, sessions merge inside each partition before they shuffle, so
    a busy key moves sessions, not calls. Calls later than ``delay`` are dropped and counted by
    Spark's own metric. A burst is emitted once the watermark passes it.
    """
    tokens = zero("input_tokens") + zero("output_tokens") + zero("reasoning_tokens")
    return (calls.withWatermark("created_at", delay)
            .groupBy(F.session_window("created_at", f"{vocab.BURST_GAP_SECONDS} seconds"), *keys)
            .agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens"),
                 F.min("created_at").alias("first"), F.max("created_at").alias("last")))


LINE = "scene_id, unit_id, sequence_index, unit_type, text, heading"


def graph_store(spark: SparkSession, folder: str, scene_id: T.DataType, unit_id: T.DataType, **options) -> Store:
    """Stored lines, and for each scene read its content hash and facts."""
    lines = T.StructType([T.StructField("scene_id", scene_id), T.StructField("unit_id", unit_id), T.StructField("sequence_index", T.LongType()),
                          *[T.StructField(c, T.StringType()) for c in ("unit_type", "text", "heading")]])
    facts = T.StructType([T.StructField("scene_id", scene_id), T.StructField("input_hash", T.StringType()),
                          *[T.StructField(c, T.StringType()) for c in ("entity_type", "name")], T.StructField("unit_id", unit_id),
                          T.StructField("lines", T.LongType())])
    return Store(spark, folder, {"lines": lines, "facts": facts}, "scene_id", **options)


def newest_lines(held: DataFrame) -> DataFrame:
    """Of each stored line the newest; among those of one batch the last in order, then by type and text."""
    return held.groupBy("scene_id", "unit_id").agg(
        F.max(F.struct("batch", "sequence_index", "unit_type", "text", "heading")).alias("u")).select("scene_id", "unit_id", "u.*")


def newest_facts(held: DataFrame) -> DataFrame:
    """Of each scene the rows of the newest batch that read it."""
    last = held.groupBy("scene_id").agg(F.max("batch").alias("batch"))
    return held.join(last, ["scene_id", "batch"], "left_semi")


def rule_graph(units: DataFrame, folder: str, checkpoint: str, fingerprint: str, **options) -> StreamingQuery:
    """The rule graph kept up with new and edited scenes.

    ``units``: scene_id, unit_id, sequence_index, unit_type, text, heading. Lines and facts
    are stored in buckets of the scene (``store``), so a batch reads only the buckets it
    touches, a bounded number of files each. A batch may hold any part of a scene: the scenes
    it touches are rebuilt from all their stored lines, of each line the newest. Scenes
    whose content is as it was last time are left out; the others get facts and a hash
    under the batch id. A scene's newest batch is its graph. A line without unit_id or
    scene_id is no line; the stored lines keep null text.
    """
    spark = units.sparkSession
    store = graph_store(spark, folder, units.schema["scene_id"].dataType, units.schema["unit_id"].dataType, **options)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        parts = store.parts(batch_id - 1)
        kept = batch.filter("scene_id IS NOT NULL AND unit_id IS NOT NULL").select(*LINE.split(", ")).withColumn(
            "sequence_index", F.col("sequence_index").cast("long"))
        kept = newest_lines(kept.withColumn("batch", F.lit(batch_id).cast("long"))).select(*LINE.split(", "))
        touched = store.add("lines", kept, batch_id, parts)
        if touched:
            held = store.read("lines", parts, touched)
            scenes = held.filter(F.col("batch") == batch_id).select("scene_id").distinct()
            lines = durable(newest_lines(held.join(scenes, "scene_id", "left_semi")).drop("batch"))
            headed = lines.groupBy("scene_id").agg(F.max("heading").alias("heading"))
            todo = build.scene_hash(headed, lines, fingerprint).select("scene_id", "input_hash", "heading")
            before = newest_facts(store.read("facts", parts, touched)).select("scene_id", "input_hash").distinct()
            todo = durable(todo.join(before, ["scene_id", "input_hash"], "left_anti"))
            work = lines.drop("heading").join(todo.select("scene_id"), "scene_id", "left_semi")
            facts = rules.provided(work, todo.select("scene_id", "heading"))
            shape = store.schemas["facts"]
            marks = todo.select("scene_id", "input_hash")
            rows = marks.join(facts, "scene_id", "left").select(*[F.col(f.name).cast(f.dataType) for f in shape.fields])
            store.add("facts", rows, batch_id, parts)
            store.compact("lines", batch_id, parts, newest_lines)
            store.compact("facts", batch_id, parts, newest_facts)
        store.close(batch_id, parts)
    return (units.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_graph(store: Store) -> DataFrame:
    """Facts of each scene's newest batch; earlier ones are superseded."""
    held = store.read("facts", store.parts(store.newest_manifest()))
    return newest_facts(held).filter("entity_type IS NOT NULL").drop("input_hash", "batch")


class RunningTotal(StatefulProcessor):
    """T4: one total per key, kept from batch to batch and, with an expiry, dropped when it has not grown for that long."""

    def __init__(self, cap: int, expiry_ms: int | None):
        self.cap, self.expiry_ms = cap, expiry_ms

    def init(self, handle) -> None:
        self.total = handle.getValueState("total", "total long", ttlDurationMs=self.expiry_ms)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        held = int(self.total.get()[0]) if self.total.exists() else 0
        calls = pd.concat(list(rows), ignore_index=True).sort_values(["created_at", "call_id"], kind="stable")
        spent = calls["spent"].to_numpy("int64")
        before = held + spent.cumsum() - spent
        self.total.update((held + int(spent.sum()),))
        calls["spent_before"], calls["refused"] = before, before >= self.cap
        yield calls.drop(columns=["spent"])

    def close(self) -> None:
        pass


def budget_gate(calls: DataFrame, keys: list[str], cap: int, folder: str, checkpoint: str, expiry_ms: int | None = None) -> StreamingQuery:
    """T4: calls refused once their key's recorded tokens reach the cap.

    Each key's running total is keyed state of the query, so a batch touches the totals of
    its own keys only and nothing is read back from tables. Calls are taken in the order of
    their batches, inside a batch by (created_at, call_id); only the columns of the gate pass
    through the state operator. One key's calls of one batch are one task's, about sixty
    bytes each: ``maxFilesPerTrigger`` bounds them.
    """
    spark = calls.sparkSession
    spent = zero("input_tokens") + zero("output_tokens")
    narrow = calls.select(*keys, "call_id", "created_at", spent.cast("long").alias("spent"))
    shape = T.StructType([*[f for f in narrow.schema.fields if f.name != "spent"], T.StructField("spent_before", T.LongType()),
                          T.StructField("refused", T.BooleanType())])
    name, was = "spark.sql.streaming.stateStore.providerClass", None
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        gated = narrow.groupBy(*keys).transformWithStateInPandas(
            RunningTotal(cap, expiry_ms), shape, "Append", "none" if expiry_ms is None else "ProcessingTime")
        return to_parquet(gated, folder, checkpoint)
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)

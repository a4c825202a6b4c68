"""Streaming jobs run over the whole tables until no file is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.registry import query
from plotline.sources.tables import MODEL, OUTCOME, PURPOSE, SCHEMAS, with_
from plotline.streaming import jobs


@query("T1_stream_dedupe", """SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (
    SELECT sha256(text) FROM documents JOIN labels USING (doc_id))""")
def t1(t):
    docs = jobs.read_stream(t.spark, t.folder, "documents", SCHEMAS["documents"])
    payloads = docs.select(F.col("doc_id").alias("import_id"), F.encode("text", "UTF-8").alias("content"),
                           F.timestamp_seconds("doc_id").alias("imported_at"))
    seen = t.documents.join(t.labels, "doc_id").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))
    out = jobs.new_folder(t.spark, "copies")
    jobs.to_parquet(jobs.first_copies(payloads, seen, "imported_at", "1 day"), out, f"{out}-state").awaitTermination()
    return t.spark.read.schema("content_hash string").parquet(out)


def call_stream(t):
    events = jobs.read_stream(t.spark, t.folder, "events", SCHEMAS["events"])
    tokens = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("created_at"), "event_type",
        F.expr(PURPOSE).alias("purpose"), F.col("user_id").alias("script_id"), F.expr(MODEL).alias("model_id"),
        F.expr(OUTCOME).alias("outcome"), F.when(F.col("value") >= 1, tokens).alias("input_tokens"),
        F.floor("value").alias("output_tokens"), F.when(F.col("event_type") == "error", tokens).alias("reasoning_tokens"))


BURSTS = """g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 1200 SECONDS THEN event_id END AS opened
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    b AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS burst FROM g)"""


@query("T2_stream_bursts", "WITH " + BURSTS + """ SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, count(*) AS calls,
    CAST(sum(CASE WHEN value >= 1 THEN CAST(props ->> '$.k' AS BIGINT) ELSE 0 END + floor(value) + CASE WHEN event_type = 'error' THEN
      CAST(props ->> '$.k' AS BIGINT) ELSE 0 END) AS BIGINT) AS tokens FROM b GROUP BY event_type, burst
    HAVING max(ts) + INTERVAL 1200 SECONDS <= (SELECT max(ts) FROM events) - INTERVAL 600 SECONDS""")
def t2(t):
    out = jobs.new_folder(t.spark, "bursts")
    ledger = jobs.burst_ledger(call_stream(t), ["event_type"], "600 seconds").drop("session_window")
    jobs.to_parquet(ledger, out, f"{out}-state").awaitTermination()
    return t.spark.read.parquet(out).select(
        "event_type", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first_at"), "calls", "tokens")


@query("T3_stream_rule_graph", """WITH l AS (SELECT conv_id, turn, max(upper(role)) AS name FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2)
    SELECT conv_id AS scene_id, 'cast' AS entity_type, name, min(turn) AS unit_id, count(*) AS lines FROM l WHERE name IS NOT NULL GROUP BY 1, 3
    UNION ALL SELECT DISTINCT conv_id, 'location', 'ROOM ' || conv_id, -1, 1 FROM conversations WHERE conv_id IS NOT NULL""")
def t3(t):
    rows = jobs.read_stream(t.spark, t.folder, "conversations", SCHEMAS["conversations"])
    heading = F.concat(F.lit("INT. ROOM "), "conv_id", F.lit(" - NIGHT"))
    cue = F.struct(F.col("turn").alias("unit_id"), F.lit("character").alias("unit_type"), F.upper("role").alias("text"))
    head = F.struct(F.lit(-1).cast("long").alias("unit_id"), F.lit("scene_heading").alias("unit_type"), heading.alias("text"))
    units = rows.select(F.col("conv_id").alias("scene_id"), heading.alias("heading"), F.explode(F.array(head, cue)).alias("u")).select(
        "scene_id", "heading", "u.*").withColumn("sequence_index", F.col("unit_id"))
    out = jobs.new_folder(t.spark, "rules")
    jobs.rule_graph(units, out, f"{out}-state", "v1").awaitTermination()
    store = jobs.graph_store(t.spark, out, units.schema["scene_id"].dataType, units.schema["unit_id"].dataType)
    return jobs.current_graph(store).select("scene_id", "entity_type", "name", "unit_id", "lines")


@query("T4_stream_budget", with_("calls", then="""SELECT model_id, count(*) FILTER (before >= 50000) AS refused, count(*) FILTER (before < 50000)
      AS made FROM (SELECT model_id, coalesce(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) OVER (PARTITION BY model_id ORDER BY
      created_at, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM calls) GROUP BY 1"""))
def t4(t):
    out = jobs.new_folder(t.spark, "budget")
    jobs.budget_gate(call_stream(t), ["model_id"], 50000, out, f"{out}-state").awaitTermination()
    return t.spark.read.parquet(out).groupBy("model_id").agg(
        F.count_if("refused").alias("refused"), F.count_if(~F.col("refused")).alias("made"))

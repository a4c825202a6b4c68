"""Window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions import figures
from plotline.operators import filters as P
from plotline.operators import scans
from plotline.operators import windows as W
from plotline.registry import query
from plotline.sources.tables import with_


def turns(t):
    """Conversations as one scene each: cue, speech and direction by role."""
    return t.conversations.select(
        F.col("conv_id").alias("scene_id"), F.col("turn").alias("sequence_index"),
        F.col("turn").alias("unit_id"), "text",
        F.expr("CASE role WHEN 'user' THEN 'character' WHEN 'assistant' THEN 'dialogue' "
               "ELSE 'action' END").alias("unit_type"),
        F.expr("CASE role WHEN 'user' THEN 'USER' END").alias("speaker"))


@query("W1_row_position", with_("scenes", then="SELECT scene_id, sequence_index FROM scenes"))
def w1(t):
    return t.ordered_scenes.select("scene_id", "sequence_index")


@query("W2_burst_sessions", """WITH g AS (SELECT event_id, event_type, ts, CASE WHEN lag(ts) OVER w IS NULL
      OR ts > lag(ts) OVER w + INTERVAL 1200 SECONDS THEN event_id END AS opened FROM events
      WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    b AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id)
      AS burst FROM g)
    SELECT event_type, burst, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS ids FROM b GROUP BY 1, 2""")
def w2(t):
    calls = scans.bursts(t.events, ["event_type"], "ts", "event_id", vocab.BURST_GAP_SECONDS, "start")
    return calls.groupBy("event_type", "start").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("burst"), F.count(F.lit(1)).alias("calls"),
        F.sum("event_id").alias("ids")).drop("start")


@query("W3_carry_forward", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END
      IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS cue FROM conversations""")
def w3(t):
    cue = F.when(F.col("unit_type") == "character", F.col("sequence_index"))
    return W.carried(turns(t), "cue", cue).select(
        F.col("scene_id").alias("conv_id"), F.col("sequence_index").alias("turn"), "cue")


@query("W4_running_page", """SELECT conv_id, turn, coalesce(CAST(sum(length(text)) OVER (PARTITION BY conv_id
      ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) // 800 + 1 AS page
    FROM conversations""")
def w4(t):
    rows = scans.running_sum(t.conversations, ["conv_id"], [F.col("turn")], F.char_length("text"), "offset")
    return rows.select("conv_id", "turn", figures.page_of(F.col("offset")).alias("page"))


@query("W5_join_wrapped_lines", """WITH l AS (SELECT conv_id, turn, role, CASE WHEN role <> 'user'
      AND lag(role) OVER w = role THEN 0 ELSE 1 END AS opens, text FROM conversations
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM l)
    SELECT conv_id, min(turn) AS turn, count(*) AS lines, md5(string_agg(text, ' ' ORDER BY turn)) AS digest
    FROM r GROUP BY conv_id, run""")
def w5(t):
    return W.join_wrapped(turns(t)).select(
        F.col("scene_id").alias("conv_id"), F.col("sequence_index").alias("turn"), "lines",
        F.md5("text").alias("digest"))


@query("W6_last_five", """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (
    PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5""")
def w6(t):
    return P.first_in(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select(
        "user_id", "event_id")


@query("W7_latest_per_key", """SELECT user_id, max_by(event_id, (ts, event_id)) AS last_event,
    max_by(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1""")
def w7(t):
    rows = t.events.select("user_id", "ts", "event_id", F.col("event_id").alias("last_event"),
                           F.col("event_type").alias("last_type"))
    return W.latest(rows, ["user_id"], ["ts", "event_id"], ["last_event", "last_type"])


@query("W8_settle_cues", """SELECT conv_id, count(*) FILTER (role = 'user' AND nxt IS DISTINCT FROM 'assistant'
      AND nxt IS NOT NULL AND length(text) % 3 <> 0) AS demoted FROM (SELECT *, lead(role) OVER (
      PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) GROUP BY 1""")
def w8(t):
    units = turns(t).withColumn("unit_id", F.concat_ws("-", "scene_id", "sequence_index"))
    cited = units.filter(F.char_length("text") % 3 == 0).select("unit_id")
    return W.settle_cues(units, cited).groupBy(F.col("scene_id").alias("conv_id")).agg(
        F.count_if("demoted").alias("demoted"))


@query("W9_speaker_above", """SELECT conv_id, turn, last_value(CASE role WHEN 'user' THEN 'USER' END
    IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS speaker_above FROM conversations""")
def w9(t):
    return W.speaker_above(turns(t)).select(F.col("scene_id").alias("conv_id"),
                                            F.col("sequence_index").alias("turn"), "speaker_above")


@query("W10_context_window", """WITH m AS (SELECT *, max(CASE WHEN contains(lower(text), 'queque') THEN 1 ELSE 0
      END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near,
      max(CASE WHEN contains(lower(text), 'queque') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS hit,
      count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM m
      WHERE n <= 3 OR near = 1 OR hit = 0)
    SELECT conv_id, turn, (SELECT count(*) FROM k x WHERE x.conv_id = k.conv_id) AS total FROM k WHERE n <= 3 OR r <= 3""")
def w10(t):
    hit = F.contains(F.lower("text"), F.lit("queque"))
    return W.context_window(turns(t), hit, 1, 3).select(F.col("scene_id").alias("conv_id"),
                                                        F.col("sequence_index").alias("turn"), "total")


@query("W11_first_text", """SELECT user_id AS unit_id, min_by(event_id, (ts, event_id)) AS original_text
    FROM events WHERE event_type <> 'error' GROUP BY 1""")
def w11(t):
    operations = t.events.select(
        F.col("user_id").alias("unit_id"), F.col("ts").alias("created_at"),
        F.col("event_id").alias("sequence_index"), F.col("event_id").alias("before_text"),
        F.lit("set_unit_text").alias("operation_type"),
        F.when(F.col("event_type") == "error", "undo").otherwise("edit").alias("kind"))
    return W.first_text(operations)


@query("W12_read_windows", """SELECT conv_id, turn, CASE WHEN r > 3 THEN 'w' || (r - 1) // 3 || ':' ELSE '' END
    AS id_prefix FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r
    FROM conversations)""")
def w12(t):
    return W.read_windows(turns(t), 3).select(F.col("scene_id").alias("conv_id"),
                                              F.col("sequence_index").alias("turn"), "id_prefix")


@query("W13_top_evidence", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k - 1 AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey,
      l_suppkey) AS k FROM lineitem) WHERE k <= 8""")
def w13(t):
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]
    return P.first_in(t.lineitem, ["l_orderkey"], order, vocab.FINDING_EVIDENCE_CAP).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("rank") - 1).alias("rank"))



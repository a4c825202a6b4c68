"""Conversation replay, scene sheet, library sheet, stored questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import aggregates
from plotline.plans import views
from plotline.registry import query
from plotline.sources.tables import SQL, with_


@query("G44_replay", """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN coalesce(o_orderstatus, 'gone') END AS proposal FROM conversations
    LEFT JOIN orders ON o_orderkey = conv_id * 10 + turn""")
def g44(t):
    turns = t.conversations.withColumn("change_set_id", F.when(F.col("role") == "assistant", F.col("conv_id") * 10 + F.col("turn")))
    sets = t.orders.select(F.col("o_orderkey").alias("change_set_id"), F.col("o_orderstatus").alias("status"))
    return views.replay(turns, sets).select("conv_id", "turn", "proposal")


@query("G44_recent_history", """SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k
    FROM conversations) WHERE k <= 4""")
def g44_history(t):
    return views.recent_history(t.conversations.withColumnRenamed("conv_id", "conversation_id"), 4).select(
        F.col("conversation_id").alias("conv_id"), "turn")


@query("G48_scene_sheet", with_("scenes", "facts", then=""", z AS (SELECT scene_id, script_id, number, omitted, sequence_index, coalesce(n, 0) AS n,
      coalesce(c, 0) AS c, coalesce(fl, 0) AS fl, coalesce(e, 0) AS e FROM scenes
      LEFT JOIN (SELECT l_orderkey AS scene_id, count(*) AS n, CAST(sum(l_quantity * 9) AS BIGINT) AS c, count(*) FILTER (l_tax > 0.07) AS fl FROM lineitem GROUP BY 1) USING (scene_id)
      LEFT JOIN (SELECT subject_scene_id AS scene_id, count(DISTINCT object_entity_id) AS e FROM facts WHERE active AND subject_scene_id IS NOT NULL
        GROUP BY 1) USING (scene_id)),
    y AS (SELECT *, greatest(1, CAST(round_even(c / 100, 0) AS BIGINT)) AS k, coalesce(sum(c) OVER (PARTITION BY script_id ORDER BY sequence_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM z)
    SELECT scene_id, coalesce(number, '') AS number, CAST(floor(o / 800) + 1 AS BIGINT) AS page, CASE WHEN k >= 8 AND k % 8 > 0 THEN k // 8 || ' ' || k % 8 || '/8'
      WHEN k >= 8 THEN (k // 8)::VARCHAR ELSE k % 8 || '/8' END AS eighths, n AS lines, e AS entities, fl AS flagged, NOT omitted AND scene_id % 5 = 0 AS new_in_draft
    FROM y""").replace("\n, z AS", ", z AS"))
def g48(t):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    units = t.lineitem.select(F.col("l_orderkey").alias("scene_id"), key.alias("unit_id"), F.repeat(F.lit("lines of "), F.col("l_quantity").cast("int")).alias("text"))
    flagged = t.lineitem.filter("l_tax > 0.07").select(key.alias("unit_id"))
    scenes = t.ordered_scenes.withColumns({
        "predecessor_scene_id": F.when(F.col("scene_id") % 5 != 0, F.col("scene_id")), "is_draft": F.lit(True)})
    return views.scene_sheet(scenes, units, t.facts.drop("scene_id"), flagged).select(
        "scene_id", "number", "page", "eighths", "lines", "entities", "flagged", "new_in_draft")


@query("G48_revision_baseline", """SELECT coalesce(d.doc_id, e.doc_id) AS unit_id, CASE WHEN d.doc_id IS NOT NULL THEN d.source ELSE e.lang END AS baseline
    FROM (SELECT * FROM documents WHERE n_chars % 2 = 0) d FULL JOIN (SELECT * FROM documents WHERE n_chars % 3 = 0) e ON d.doc_id = e.doc_id""")
def g48_baseline(t):
    drafted = t.documents.filter("n_chars % 2 = 0").select(F.col("doc_id").alias("unit_id"), F.col("source").alias("baseline"))
    edited = t.documents.filter("n_chars % 3 = 0").select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("baseline"))
    return views.revision_baseline(drafted, edited)


@query("G49_library_sheet", "WITH " + SQL["scripts"] + """, c AS (SELECT o_custkey AS script_id, count(*) AS scenes, sum(length(o_orderpriority)) AS chars,
      min_by(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY 1),
    g AS (SELECT DISTINCT o_custkey AS script_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'O')
    SELECT script_id, title, import_status, coalesce(st, 'unknown') AS format, coalesce(greatest(1, CAST(round_even(chars * 50 / 800.0, 0) AS BIGINT)), 1) AS pages,
      coalesce(scenes, 0) AS scenes, g.script_id IS NOT NULL AS has_graph, CASE WHEN st = 'P' THEN 'odd' ELSE '' END AS warnings
    FROM scripts LEFT JOIN c USING (script_id) LEFT JOIN g USING (script_id)""")
def g49(t):
    note = lambda m: F.struct(F.lit("x").alias("code"), m.alias("message"))
    imports = t.orders.select(
        F.col("o_custkey").alias("script_id"), F.col("o_orderstatus").alias("format"), F.col("o_orderdate").alias("imported_at"),
        F.col("o_orderkey").alias("import_id"), F.array(note(F.lit("")), note(F.when(F.col("o_orderstatus") == "P", "odd").otherwise("")))
        .alias("warnings"))
    units = t.orders.select(F.col("o_custkey").alias("script_id"), F.repeat("o_orderpriority", F.lit(50)).alias("text"),
                            F.lit(None).cast("int").alias("page_number"))
    graphed = t.lineitem.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(
        t.orders, "o_orderkey").select(F.col("o_custkey").alias("script_id"))
    sheet = views.library_sheet(t.scripts, imports, t.scenes, aggregates.pages_per_script(units), graphed)
    return sheet.drop("runtime").withColumn("warnings", F.array_join("warnings", ";"))


@query("G50_stored_questions", with_("facts", then=""", c AS (SELECT DISTINCT l_suppkey AS query_id, l_orderkey || '-' || l_linenumber || '-' || CASE WHEN l_tax > 0.07
      THEN -1 ELSE l_partkey END || '-' || l_suppkey AS aid FROM lineitem)
    SELECT query_id, count(*) AS grounded_in, count(DISTINCT source_unit_id) AS total_units, round(avg(confidence) + 1e-9, 2) AS mean_confidence
    FROM c JOIN facts ON assertion_id = aid GROUP BY 1""").replace("\n, c AS", ", c AS"))
def g50(t):
    part = F.when(F.col("l_tax") > 0.07, -1).otherwise(F.col("l_partkey"))
    log = t.lineitem.select(F.col("l_suppkey").alias("query_id"), F.concat_ws(
        "-", "l_orderkey", "l_linenumber", part, "l_suppkey").alias("assertion_id"))
    facts = t.facts.withColumn("confidence", F.col("confidence") + 1e-9)
    return views.stored_question(log, facts)

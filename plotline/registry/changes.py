"""Change dataflows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plotline.operators import joins as J
from plotline.operators import ledger
from plotline.plans import build, changes, views
from plotline.registry import query
from plotline.registry.joins import FINDINGS
from plotline.session import durable
from plotline.sources.tables import with_


def operations(t):
    """Removals of large lines and re-aimed updates of small ones, in shipping order.

    A fact meets every line of its id: lines are dealt by order once and each gets those of its own four keys.
    """
    line = F.struct("l_quantity", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("accepted_order"),
                    F.col("l_linenumber").cast("long").alias("sequence_index"))
    same = Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = t.lineitem.repartition("l_orderkey").withColumn("_lines", F.collect_list(line).over(same))
    lines = lines.withColumn("_lines", F.filter("_lines", lambda x: (x["l_quantity"] > 40) | (x["l_quantity"] < 10)))
    rows = t.owned(t.facts_of(lines.filter(F.size("_lines") > 0), "_lines")).select("*", F.inline("_lines"))
    update = F.col("l_quantity") < 10
    return rows.select(
        F.col("accepted_order").alias("change_set_id"), "accepted_order", "sequence_index",
        F.when(update, "update_assertion").otherwise("remove_assertion").alias("operation_type"),
        F.col("assertion_id").alias("target_id"), "script_id", "subject_kind", "subject_entity_id",
        "subject_scene_id", "predicate", "object_kind", (F.col("object_entity_id") + 1).alias("object_entity_id"),
        "object_scene_id", F.when(update, F.col("source_unit_id")).alias("source_unit_id"),
        F.lit(0.8).alias("confidence"))


KEY = ("script_id || '#' || subject_kind || '|' || coalesce(subject_entity_id, subject_scene_id) || '|' || predicate "
       "|| '|' || object_kind || '|' || {o} || '|' || source_unit_id")
APPLY = with_("facts", "assertions", then=f""", q AS (SELECT a.*, l_quantity AS qty, (datediff('day', DATE '1990-01-01',
      l_shipdate::DATE) * 100 + l_linenumber) * 10 AS z, {KEY.format(o='object_entity_id')} AS k,
      {KEY.format(o='(object_entity_id + 1)')} AS nk FROM assertions a JOIN lineitem ON assertion_id =
      l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey),
    held AS (SELECT k, max_by(assertion_id, (active, assertion_id)) AS r FROM q GROUP BY 1),
    up AS (SELECT coalesce(r, nk) AS id, z + 1 AS z, true AS act, 0.8 AS conf, predicate AS pr, r IS NULL AS fresh FROM q
      LEFT JOIN held h ON h.k = q.nk WHERE qty < 10),
    ev AS (SELECT id, z, act, conf FROM up UNION ALL SELECT assertion_id, z, false, NULL FROM q WHERE qty < 10 OR qty > 40),
    fin AS (SELECT id, max_by(act, z) AS act, max_by(conf, z) FILTER (conf IS NOT NULL) AS conf FROM ev GROUP BY 1),
    res AS (SELECT predicate, coalesce(f.act, active) AS active, coalesce(f.conf, confidence) AS confidence FROM q
      LEFT JOIN fin f ON f.id = assertion_id
      UNION ALL SELECT pr, act, conf FROM (SELECT DISTINCT id, pr FROM up WHERE fresh) JOIN fin USING (id))
    SELECT predicate, active, count(*) AS n, round(sum(confidence), 4) AS confidence FROM res GROUP BY 1, 2
    """).replace("\n, q AS", ", q AS")


@query("G3_apply_changes", APPLY)
def g3(t):
    after = changes.apply_assertions(t.assertions, durable(operations(t)))
    return after.groupBy("predicate", "active").agg(F.count(F.lit(1)).alias("n"),
                                                    F.round(F.sum("confidence"), 4).alias("confidence"))


@query("G3_apply_attributes", """WITH v AS (SELECT p_brand AS e, p_type AS k, p_name AS v, p_partkey AS z FROM part),
    c AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY e, k ORDER BY z), '') <> v AS w FROM v)
    SELECT e AS entity_id, k AS key, count(*) AS history, max_by(v, z) AS value FROM c WHERE w GROUP BY 1, 2""")
def g3_attributes(t):
    none = t.spark.createDataFrame([], "attribute_id string, entity_id string, key string, value string, active boolean")
    sets = t.part.select(
        F.lit("set_entity_attribute").alias("operation_type"), F.lit(None).cast("string").alias("target_id"),
        F.col("p_brand").alias("entity_id"), F.col("p_type").alias("key"), F.col("p_name").alias("value"),
        F.col("p_partkey").alias("accepted_order"), F.lit(0).cast("long").alias("sequence_index"))
    after = changes.apply_attributes(none, sets)
    return after.groupBy("entity_id", "key").agg(F.count(F.lit(1)).alias("history"),
                                                 F.max(F.when(F.col("active"), F.col("value"))).alias("value"))


@query("G3_apply_texts", """SELECT c_custkey AS unit_id, coalesce(max_by(o_orderstatus, (o_orderdate, o_orderkey)), c_name) AS text,
    1 + count(o_orderkey) AS current_version FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY c_custkey, c_name""")
def g3_texts(t):
    units = t.customer.select(F.col("c_custkey").alias("unit_id"), F.col("c_name").alias("text"),
                              F.lit(1).cast("long").alias("current_version"))
    ops = t.orders.select(
        F.lit("set_unit_text").alias("operation_type"), F.col("o_custkey").alias("target_id"),
        F.col("o_orderstatus").alias("text"), F.col("o_orderdate").alias("accepted_order"),
        F.col("o_orderkey").alias("sequence_index"), F.col("o_orderkey").alias("change_set_id"))
    return changes.apply_texts(units, ops)


@query("G4_stale_check", """SELECT o_orderkey AS change_set_id, CASE WHEN o_orderkey % 25 + 1 <> c_nationkey + 1 THEN 'stale'
      WHEN bool_or(l_partkey >= 1900) THEN 'failed' WHEN bool_or(l_linenumber <> l_partkey % 7) THEN 'stale' ELSE 'ok' END AS "check"
    FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY o_orderkey, c_nationkey""")
def g4(t):
    sets = t.orders.select(F.col("o_orderkey").alias("change_set_id"), F.col("o_custkey").alias("script_id"),
                           (F.col("o_orderkey") % 25 + 1).alias("base_script_version"))
    edited = t.lineitem.select(F.col("l_orderkey").alias("change_set_id"), F.col("l_partkey").alias("unit_id"),
                               F.col("l_linenumber").alias("base_unit_version"))
    units = t.part.filter("p_partkey < 1900").select(F.col("p_partkey").alias("unit_id"),
                                                     (F.col("p_partkey") % 7).alias("current_version"))
    return changes.check_versions(sets, t.scripts, edited, units)


@query("G5_undo_operations", """WITH o AS (SELECT l_orderkey AS cs, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
      l_partkey, l_suppkey) - 1 AS i, l_linenumber % 4 AS k, l_returnflag = 'R' AS fresh, l_partkey FROM lineitem)
    SELECT cs AS change_set_id, max(i) OVER (PARTITION BY cs) - i AS sequence_index, CASE k WHEN 0 THEN 'remove_assertion'
      WHEN 1 THEN 'add_assertion' WHEN 2 THEN CASE WHEN fresh THEN 'remove_entity_attribute' ELSE 'set_entity_attribute' END
      ELSE 'set_unit_text' END AS operation_type, l_partkey AS target_id, CASE WHEN NOT fresh THEN 'b' END AS after_json FROM o""")
def g5(t):
    from plotline.operators.scans import ordinal
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    rows = ordinal(t.lineitem, ["l_orderkey"], order, "n")
    ops = rows.select(
        F.col("l_orderkey").alias("change_set_id"), (F.col("n") - 1).alias("sequence_index"),
        F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'add_assertion' WHEN 1 THEN 'remove_assertion' WHEN 2 THEN "
               "'set_entity_attribute' ELSE 'set_unit_text' END").alias("operation_type"),
        F.lit("any").alias("target_type"), F.col("l_partkey").alias("target_id"),
        F.when(F.col("l_returnflag") != "R", "b").alias("before_json"), F.lit("a").alias("after_json"))
    return changes.inverse_operations(ops).select("change_set_id", "sequence_index", "operation_type",
                                                  "target_id", "after_json")


# Orders as change sets over one script per customer; every line is one operation on its own fact or on its part's text.
UNDO_SQL = """l AS (SELECT o_orderkey AS cs, o_custkey AS script, o_orderdate AS took, l_linenumber % 3 AS k, l_partkey AS unit, concat_ws('-', l_orderkey,
      l_linenumber, l_partkey, l_suppkey) AS id, l_linestatus = 'O' AS active, l_tax > 0.07 AS flagged, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, o_orderstatus AS st FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    u AS (SELECT DISTINCT cs FROM (SELECT unit, max_by(cs, (took, cs)) AS cs FROM l WHERE st = 'F' GROUP BY 1))"""


def undone(t):
    from plotline.operators.scans import ordinal
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    rows = ordinal(t.lineitem, ["l_orderkey"], order, "n").withColumns({"id": key, "k": F.col("l_linenumber") % 3})
    sets = t.orders.select(F.col("o_orderkey").alias("change_set_id"), F.col("o_custkey").alias("script_id"), F.expr(
        "CASE o_orderstatus WHEN 'F' THEN 'accepted' ELSE 'pending' END").alias("status"), F.col("o_orderdate").alias("accepted_at"))
    ops = rows.select(
        F.col("l_orderkey").alias("change_set_id"), (F.col("n") - 1).alias("sequence_index"), F.expr(
            "CASE k WHEN 0 THEN 'add_assertion' WHEN 1 THEN 'remove_assertion' ELSE 'set_unit_text' END").alias("operation_type"),
        F.lit("any").alias("target_type"), F.when(F.col("k") == 2, F.col("l_partkey").cast("string")).otherwise(F.col("id")).alias("target_id"),
        F.to_json(F.struct(F.concat(F.lit("before "), "id").alias("text"))).alias("before_json"), F.lit('{"text": "new"}').alias("after_json"))
    units = t.part.select(F.col("p_partkey").cast("string").alias("unit_id"), F.col("p_name").alias("text"), F.lit(1).cast("long").alias("current_version"))
    edited = t.lineitem.select(F.col("l_orderkey").alias("change_set_id"), F.col("l_partkey").cast("string").alias("unit_id"))
    scripts = t.customer.select(F.col("c_custkey").alias("script_id"), F.lit(1).cast("long").alias("current_version"))
    findings = rows.filter("l_tax > 0.07").select(F.col("l_orderkey").alias("change_set_id"), F.col("id").alias("finding_id"), F.lit("open").alias("status"))
    return changes.undo(units.select("unit_id"), sets, edited, ops, scripts, units, t.assertions, findings)


@query("G5_undo_facts", "WITH " + UNDO_SQL + """ SELECT id AS assertion_id, CASE WHEN u.cs IS NULL OR k = 2 THEN active ELSE k = 1 END AS active
    FROM l LEFT JOIN u USING (cs)""")
def g5_undo_facts(t):
    return undone(t)["assertions"].select("assertion_id", "active")


@query("G5_undo_texts", "WITH " + UNDO_SQL + """, n AS (SELECT cs, max(i) AS last FROM l GROUP BY 1), x AS (SELECT unit, max_by('before ' || id,
      (took, cs, last - i)) AS text, count(DISTINCT cs) AS n FROM l JOIN u USING (cs) JOIN n USING (cs) WHERE k = 2 GROUP BY 1)
    SELECT p_partkey::VARCHAR AS unit_id, coalesce(text, p_name) AS text, 1 + coalesce(n, 0) AS current_version FROM part LEFT JOIN x ON unit = p_partkey""")
def g5_undo_texts(t):
    return undone(t)["units"].select("unit_id", "text", "current_version")


@query("G5_undo_states", "WITH " + UNDO_SQL + """ SELECT 'set ' || CASE WHEN u.cs IS NOT NULL THEN 'reverted' WHEN o_orderstatus = 'F' THEN 'accepted'
      ELSE 'pending' END AS name, count(*) AS n FROM orders LEFT JOIN u ON cs = o_orderkey GROUP BY 1
    UNION ALL SELECT 'finding ' || CASE WHEN u.cs IS NULL THEN 'open' ELSE 'resolved' END, count(*) FROM l LEFT JOIN u USING (cs) WHERE flagged GROUP BY 1
    UNION ALL SELECT 'versions', (SELECT count(*) FROM customer) + (SELECT count(*) FROM u)""")
def g5_undo_states(t):
    after = undone(t)
    return (after["change_sets"].groupBy(F.concat(F.lit("set "), "status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
            .unionByName(after["findings"].groupBy(F.concat(F.lit("finding "), "status").alias("name")).agg(F.count(F.lit(1)).alias("n")))
            .unionByName(after["scripts"].agg(F.lit("versions").alias("name"), F.sum("current_version").alias("n"))))


@query("G5_reject", """WITH d AS (SELECT o_orderkey AS cs, o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' AS over FROM orders)
    SELECT 'set ' || CASE WHEN over THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'pending' END AS name, count(*) AS n
    FROM d JOIN orders ON o_orderkey = cs GROUP BY 1
    UNION ALL SELECT 'finding ' || CASE WHEN over THEN 'resolved' ELSE 'open' END, count(*) FROM d JOIN lineitem ON l_orderkey = cs GROUP BY 1
    UNION ALL SELECT 'note', count(*) FROM d JOIN orders ON o_orderkey = cs WHERE over AND o_orderpriority = '1-URGENT'""")
def g5_reject(t):
    sets = t.orders.select(F.col("o_orderkey").alias("change_set_id"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'accepted' ELSE 'pending' END").alias("status"))
    findings = t.lineitem.select(F.col("l_orderkey").alias("change_set_id"), F.lit("open").alias("status"))
    decided = t.orders.filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("change_set_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "not now").alias("reason"))
    after, notes = changes.reject(sets, findings, decided)
    kind = F.when(F.col("finding_type") == "rejection_note", "note").otherwise(F.concat(F.lit("finding "), "status"))
    return (after.groupBy(F.concat(F.lit("set "), "status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
            .unionByName(notes.groupBy(kind.alias("name")).agg(F.count(F.lit(1)).alias("n"))))


@query("G5_latest_accepted", """SELECT l_partkey AS unit_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS change_set_id
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def g5_latest(t):
    sets = t.orders.select(F.col("o_orderkey").alias("change_set_id"), F.col("o_orderdate").alias("accepted_at"),
                           F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("pending").alias("status"))
    edited = t.lineitem.select(F.col("l_orderkey").alias("change_set_id"), F.col("l_partkey").alias("unit_id"))
    return changes.latest_accepted(sets, edited)


@query("G22_proposal_reuse", """WITH p AS (SELECT o_custkey AS cs, o_orderstatus AS s, o_orderpriority AS pr FROM orders),
    s AS (SELECT cs, array_to_string(list_sort(list_distinct(list(s || pr))), ';') AS f FROM p GROUP BY 1)
    SELECT a.cs AS change_set_id, max(b.cs) AS reuse_id FROM s a JOIN s b ON a.f = b.f JOIN customer c ON c.c_custkey = b.cs
      WHERE c.c_acctbal > 0 GROUP BY 1""")
def g22(t):
    edits = t.orders.select(
        F.col("o_custkey").alias("change_set_id"), F.col("o_orderstatus").alias("unit_id"),
        F.lit(1).alias("base_version"), F.col("o_orderpriority").alias("text"), F.lit(1).alias("script_id"),
        F.lit(1).alias("base_script_version"))
    pending = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("change_set_id"),
                                                       F.col("c_custkey").alias("created_at"))
    return changes.reusable(edits, edits, pending)


@query("G23_supersede", with_("facts", then="""SELECT predicate, count(*) FILTER (active AND NOT (scene_id IN (SELECT o_orderkey
      FROM orders WHERE o_orderstatus = 'F') AND predicate <> 'uses')) AS active FROM facts GROUP BY 1"""))
def g23(t):
    rows = t.facts.withColumn("unit_scene_id", F.col("scene_id")).withColumn(
        "provenance", F.when(F.col("predicate") == "uses", "user").otherwise("model"))
    rebuilt = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("scene_id"))
    return changes.supersede(rows, rebuilt).groupBy("predicate").agg(F.count_if("active").alias("active"))


@query("G24_idempotent_write", with_("facts", then="""SELECT source_unit_id, predicate, min(assertion_id) AS assertion_id FROM facts f
    WHERE NOT active AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.active AND g.source_unit_id = f.source_unit_id
      AND g.predicate = f.predicate) GROUP BY 1, 2"""))
def g24(t):
    key = ["source_unit_id", "predicate"]
    proposed = t.facts.filter(~F.col("active")).select(*key, "assertion_id")
    return changes.new_edges(proposed, t.facts, key, [F.col("assertion_id")])


@query("G37_omit_scenes", with_("facts", then="""SELECT scene_id, count(*) AS facts, count(*) FILTER (predicate = 'establishes')
    AS introductions FROM facts WHERE active AND scene_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')
    GROUP BY 1"""))
def g37(t):
    scenes = t.orders.filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("scene_id"))
    rows = t.facts.withColumnRenamed("scene_id", "unit_scene_id")
    return changes.omission(rows, scenes).groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(F.col("predicate") == "establishes").alias("introductions"))


@query("G37_omission_operations", with_("facts", then="""SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY ph, tid) - 1
      AS sequence_index, op AS operation_type, tid AS target_id FROM (SELECT o_orderkey AS scene_id, 0 AS ph,
      'set_scene_omitted' AS op, o_orderkey::VARCHAR AS tid FROM orders WHERE o_orderpriority = '5-LOW'
      UNION ALL SELECT scene_id, 1, 'remove_assertion', assertion_id FROM facts WHERE active AND scene_id IN (
      SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'))"""))
def g37_operations(t):
    scenes = t.orders.filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("scene_id"))
    rows = t.facts.withColumnRenamed("scene_id", "unit_scene_id")
    return changes.omission_operations(changes.omission(rows, scenes), scenes)


@query("G38_resequence", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN
      turn + 2.5 ELSE turn END, turn) - 1 AS sequence_index FROM conversations WHERE length(text) % 4 <> 0""")
def g38(t):
    left = t.conversations.filter(F.char_length("text") % 4 != 0).withColumn(
        "place", F.col("turn") + F.when(F.col("role") == "system", 2.5).otherwise(0.0))
    return changes.resequence(left, ["conv_id"], "place", "turn").select("conv_id", "turn", "sequence_index")


@query("G38_guarded_delete", with_("facts", then="""SELECT count(*) AS kept FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag
    FROM lineitem) u WHERE NOT (l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM facts WHERE active AND source_unit_id =
      l_orderkey || '-' || l_linenumber))"""))
def g38_delete(t):
    units = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit_id"), "l_returnflag").distinct()
    units = units.withColumn("predecessor_unit_id", F.lit(None).cast("string"))
    keyed = units.withColumn("unit_id", F.concat_ws("/", "unit_id", "l_returnflag"))
    citing = t.facts.filter("active").select("source_unit_id").distinct().withColumn(
        "source_unit_id", F.explode(F.transform(F.array(F.lit("A"), F.lit("N"), F.lit("R")),
                                                lambda f: F.concat_ws("/", "source_unit_id", f))))
    left, _ = changes.deletable(keyed, keyed.filter("l_returnflag = 'N'").select("unit_id"), citing)
    return left.agg(F.count(F.lit(1)).alias("kept"))


@query("G39_bulk_reactivate", with_("facts", then=""", k AS (SELECT source_unit_id || predicate AS k, min(assertion_id) FILTER (NOT active
      AND confidence > 0.7) AS pick, bool_or(active) AS held FROM facts GROUP BY 1)
    SELECT predicate, count(*) AS active FROM facts JOIN k ON k = source_unit_id || predicate
    WHERE active OR (NOT held AND pick = assertion_id) GROUP BY 1""").replace("\n, k AS", ", k AS").replace("facts AS (", "facts AS ("))
def g39(t):
    rows = t.facts.withColumn("dedupe_key", F.concat("source_unit_id", "predicate"))
    wanted = rows.filter("NOT active AND confidence > 0.7").select("assertion_id")
    return changes.bulk_active(rows, wanted, True).filter("active").groupBy("predicate").agg(
        F.count(F.lit(1)).alias("active"))


@query("G40_clear_graph", with_("scripts", "scenes", "facts", "assertions", then="""SELECT 'scenes' AS name, count(*) AS n FROM scenes
    UNION ALL SELECT 'assertions', count(*) FROM assertions WHERE script_id NOT IN (SELECT script_id FROM scripts
      WHERE graph_status = 'ready')"""))
def g40(t):
    after = changes.cleared({"scenes": t.scenes, "assertions": t.assertions},
                            t.scripts.filter("graph_status = 'ready'"))
    out = [frame.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, frame in after.items()]
    return out[0].unionByName(out[1])


@query("G42_stamp_extractions", """SELECT o_orderkey AS scene_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'
    AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)""")
def g42(t):
    before = t.orders.select(F.col("o_orderkey").alias("scene_id"), (F.col("o_orderpriority") == "5-LOW").alias("omitted"),
                             F.sha2(F.concat("o_orderkey", F.lit("old")), 256).alias("input_hash"))
    after = t.orders.select(F.col("o_orderkey").alias("scene_id"),
                            F.sha2(F.concat("o_orderkey", F.lit("new")), 256).alias("input_hash"))
    key = {"prompt_version": F.lit("v1"), "model_id": F.lit("m"), "status": F.lit("completed")}
    done = before.join(t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("scene_id")), "scene_id",
                       "left_semi").select("scene_id", "input_hash").unionByName(after.join(
                           t.orders.filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("scene_id")),
                           "scene_id", "left_semi")).withColumns(key)
    return build.stamp(before, after, done, "v1", "m").select("scene_id")


@query("G43_resume_plan", """SELECT 'jobs' AS name, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'F'
    UNION ALL SELECT 'kept', count(*) FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority <> '5-LOW')""")
def g43(t):
    scenes = t.scenes.withColumn("input_hash", F.sha2(F.col("scene_id").cast("string"), 256))
    cache = t.orders.select(
        F.col("o_orderkey").alias("scene_id"), F.col("o_orderkey").alias("extraction_id"), F.expr(
            "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END").alias("status"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("input_hash"),
        F.lit("v1").alias("prompt_version"), F.when(F.col("o_orderstatus") == "O", "old").otherwise("m").alias("model_id"))
    jobs = build.pending_scenes(scenes, cache, "v1", "m")
    left = build.drop_unfinished(cache, jobs)
    return jobs.agg(F.lit("jobs").alias("name"), F.count(F.lit(1)).alias("n")).unionByName(
        left.agg(F.lit("kept").alias("name"), F.count(F.lit(1)).alias("n")))


@query("G45_budget_gate", with_("calls", then="""SELECT purpose, count(*) FILTER (before >= 200000) AS refused, count(*) FILTER
      (before < 200000) AS made FROM (SELECT purpose, coalesce(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) OVER (
      ORDER BY created_at, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM calls) GROUP BY 1"""))
def g45(t):
    calls = t.model_calls.select("call_id", "created_at", "purpose", "input_tokens", "output_tokens")
    return ledger.budget_gate(calls, 200000).groupBy("purpose").agg(
        F.count_if("refused").alias("refused"), F.count_if(~F.col("refused")).alias("made"))


@query("G46_status_moves", "WITH " + FINDINGS + """ SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'open' AND
    o_totalprice > 250000 THEN CASE WHEN o_totalprice > 400000 THEN 'dismissed' ELSE 'resolved' END ELSE status END AS status
    FROM findings JOIN orders ON o_orderkey = finding_id) GROUP BY 1""")
def g46(t):
    decisions = t.orders.filter("o_totalprice > 250000").select(
        F.col("o_orderkey").alias("finding_id"), F.lit(1).alias("position"), F.lit("open").alias("expected"),
        F.when(F.col("o_totalprice") > 400000, "dismissed").otherwise("resolved").alias("new_status"),
        F.lit("seen").alias("reason"))
    moved, _ = views.status_moves(J.findings(t), decisions, "finding_id")
    return moved.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("G47_text_saves", r"""WITH n AS (SELECT a.conv_id, a.turn, a.text, trim(regexp_replace(CASE length(a.text) % 5 WHEN 0 THEN '  '
      WHEN 1 THEN a.text ELSE coalesce(b.text, '') END, '\s+', ' ', 'g')) AS c, length(a.text) % 7 = 0 AS cited FROM conversations a
      LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
    SELECT CASE WHEN c = '' THEN 'empty' WHEN c = text THEN 'unchanged' WHEN cited THEN 'cited' ELSE 'saved' END AS state, count(*) AS n
    FROM n GROUP BY 1""")
def g47(t):
    units = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("unit_id"), "text")
    after = t.conversations.select(F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("unit_id"), F.col("text").alias("nxt"))
    size = F.char_length("text") % 5
    saves = units.join(after, "unit_id", "left").select("unit_id", F.when(size == 0, "  ").when(size == 1, F.col("text"))
                                                        .otherwise(F.coalesce("nxt", F.lit(""))).alias("new_text"))
    citing = units.filter(F.char_length("text") % 7 == 0).select(F.col("unit_id").alias("source_unit_id"))
    return changes.text_saves(saves, units, citing).groupBy("state").agg(F.count(F.lit(1)).alias("n"))

"""Further outputs of operators registered elsewhere, each checked by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import quality
from plotline.plans import build, changes, drafts, merge, retrieval, verdicts
from plotline.registry import query
from plotline.sources.tables import with_

KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def lined(t):
    """Line items with a key of their own."""
    return t.lineitem.withColumn("id", F.expr(KEY))


@query("G3_created_entities", """WITH n AS (SELECT p_brand AS s, p_type AS ty, p_name AS nm, min_by(p_size, p_partkey) AS first_size FROM part GROUP BY 1, 2, 3),
    old AS (SELECT DISTINCT p_brand AS s, p_type AS ty, p_name AS nm FROM part WHERE p_size < 10)
    SELECT n.s AS script_id, n.ty AS entity_type, n.nm AS normalized_name, CASE WHEN old.nm IS NULL THEN n.nm || '/' || first_size ELSE old.nm END
      AS canonical_name FROM n LEFT JOIN old ON old.s = n.s AND old.ty = n.ty AND old.nm = n.nm""")
def created(t):
    """Every part asks for its entity; those of small parts are there already."""
    entities = t.part.filter("p_size < 10").select(
        F.col("p_brand").alias("script_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("normalized_name"),
        F.col("p_name").alias("canonical_name")).distinct().withColumns({
            "entity_id": F.sha2(F.concat_ws("/", "script_id", "entity_type", "normalized_name"), 256), "description": F.lit(None).cast("string")})
    operations = t.part.select(
        F.lit("create_entity").alias("operation_type"), F.col("p_brand").alias("script_id"), F.col("p_type").alias("entity_type"),
        F.col("p_name").alias("normalized_name"), F.concat_ws("/", "p_name", "p_size").alias("canonical_name"), F.lit(1).alias("accepted_order"),
        F.col("p_partkey").alias("sequence_index"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("description"))
    return changes.apply_entities(entities, operations).select("script_id", "entity_type", "normalized_name", "canonical_name")


@query("G3_described_entities", """SELECT CAST(p_partkey AS VARCHAR) AS entity_id, (SELECT max_by(l_orderkey || ' says', (l_orderkey, l_linenumber)) FROM lineitem
    WHERE l_partkey = p_partkey AND l_returnflag = 'A') AS description FROM part""")
def described(t):
    entities = t.part.select(F.col("p_partkey").cast("string").alias("entity_id"), F.lit(0).alias("script_id"), F.lit("prop").alias("entity_type"),
                             F.col("p_name").alias("normalized_name"), F.col("p_name").alias("canonical_name"),
                             F.lit(None).cast("string").alias("description"))
    said = t.lineitem.select(
        F.lit("update_entity").alias("operation_type"), F.col("l_partkey").cast("string").alias("target_id"), F.col("l_orderkey").alias("accepted_order"),
        F.col("l_linenumber").alias("sequence_index"), F.lit(0).alias("script_id"), F.lit("prop").alias("entity_type"),
        F.lit(None).cast("string").alias("normalized_name"), F.lit(None).cast("string").alias("canonical_name"),
        F.when(F.col("l_returnflag") == "A", F.concat("l_orderkey", F.lit(" says"))).alias("description"))
    return changes.apply_entities(entities, said).select("entity_id", "description")


@query("G3_omitted_scenes", """SELECT o_orderkey AS scene_id, coalesce((SELECT max_by(l_returnflag = 'R', (l_shipdate, l_linenumber, l_partkey)) FROM lineitem
    WHERE l_orderkey = o_orderkey), o_orderpriority = '5-LOW') AS omitted FROM orders""")
def omitted(t):
    scenes = t.scenes.select("scene_id", "omitted")
    operations = t.lineitem.select(
        F.lit("set_scene_omitted").alias("operation_type"), F.col("l_orderkey").alias("target_id"), F.col("l_shipdate").alias("accepted_order"),
        F.struct("l_linenumber", "l_partkey").alias("sequence_index"), (F.col("l_returnflag") == "R").alias("omitted"))
    return changes.apply_omissions(scenes, operations)


@query("G9_packet_totals", with_("scripts", "facts", "assertions", then="""SELECT script_id, (SELECT count(*) FROM orders WHERE o_custkey = script_id
      AND o_orderpriority <> '5-LOW') AS scenes, (SELECT count(*) FROM part WHERE p_partkey % 1000 = script_id) AS entities,
      (SELECT count(*) FROM assertions a WHERE a.script_id = s.script_id AND active) AS assertions FROM scripts s"""))
def packet_totals(t):
    entities = t.part.select((F.col("p_partkey") % 1000).alias("script_id"))
    return retrieval.facts(t.scripts, t.scenes, entities, t.assertions).select("script_id", "scenes", "entities", "assertions")


@query("G11_merge_record", """SELECT p_partkey AS position, CAST(NULL AS BIGINT) AS skipped_by FROM part WHERE p_partkey % 10 <> 0
    UNION ALL SELECT p_partkey + 1000000000, p_partkey - 1 FROM part WHERE p_partkey % 10 = 5""")
def merge_record(t):
    """As G11: 1..9 of ten neighbours are absorbed by 0; 5 again by 4, which the earlier pairs of both forbid."""
    absorb = t.part.filter("p_partkey % 10 <> 0").select(
        F.col("p_partkey").alias("position"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("keep_id"), F.col("p_partkey").alias("absorb_id"))
    again = t.part.filter("p_partkey % 10 = 5").select(
        (F.col("p_partkey") + 1000000000).alias("position"), (F.col("p_partkey") - 1).alias("keep_id"), F.col("p_partkey").alias("absorb_id"))
    return merge.merge_record(absorb.unionByName(again)).select("position", "skipped_by")


@query("G11_refused_merges", """SELECT a.p_partkey AS position, CASE WHEN b.p_partkey IS NULL THEN 'no_such_entity' WHEN a.p_partkey = b.p_partkey THEN 'itself'
    WHEN a.p_brand <> b.p_brand THEN 'other_script' WHEN a.p_type <> b.p_type THEN 'other_type' END AS refused FROM part a LEFT JOIN part b
    ON b.p_partkey = CASE WHEN a.p_size % 5 = 0 THEN a.p_partkey ELSE a.p_partkey + a.p_size END""")
def refused_merges(t):
    other = F.when(F.col("p_size") % 5 == 0, F.col("p_partkey")).otherwise(F.col("p_partkey") + F.col("p_size"))
    pairs = t.part.select(F.col("p_partkey").alias("position"), F.col("p_partkey").alias("keep_id"), other.alias("absorb_id"))
    entities = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("script_id"), F.col("p_type").alias("entity_type"))
    return merge.refused_merges(pairs, entities).select("position", "refused")


@query("G18_attribute_operations", """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS target_id,
    CASE l_returnflag WHEN 'A' THEN 'set_entity_attribute' ELSE 'remove_entity_attribute' END AS operation_type, l_quantity AS before,
    CASE l_returnflag WHEN 'A' THEN l_tax END AS after FROM lineitem WHERE l_returnflag <> 'N'""")
def attribute_operations(t):
    final = lined(t).select(F.col("l_orderkey").alias("batch_id"), F.col("id").alias("item_id"), F.col("l_partkey").alias("entity_id"),
                            F.lit("size").alias("key"), F.col("l_quantity").alias("value"), F.col("l_tax").alias("new_value"),
                            F.expr("CASE l_returnflag WHEN 'A' THEN 'changed' WHEN 'N' THEN 'holds' ELSE 'removed' END").alias("final"))
    return verdicts.attribute_changes(final).select("target_id", "operation_type", "before", "after")


@query("G19_merged_items", """WITH o AS (SELECT DISTINCT l_orderkey AS b, p_type AS ty, p_name AS nm FROM lineitem JOIN part ON p_partkey = l_partkey
      WHERE l_returnflag = 'A'), a AS (SELECT DISTINCT l_orderkey AS b, p_type AS ty, p_name AS nm FROM lineitem JOIN part ON p_partkey = l_partkey
      WHERE l_returnflag <> 'A')
    SELECT b AS batch_id, count(*) FILTER (w = 0) AS own, count(*) FILTER (w = 1) AS added FROM (SELECT b, 0 AS w FROM o
      UNION ALL SELECT b, 1 FROM (SELECT * FROM a EXCEPT SELECT * FROM o)) GROUP BY 1""")
def merged_items(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("batch_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("normalized_name"),
        F.col("l_partkey").cast("string").alias("local_id"), (F.col("l_returnflag") == "A").alias("mine"))
    own = rows.filter("mine").groupBy("batch_id", "entity_type", "normalized_name").agg(F.min("local_id").alias("local_id"))
    made = verdicts.merge_new_items(own, rows.filter("NOT mine").drop("mine"))
    other = F.startswith("local_id", F.lit("x:"))
    return made.groupBy("batch_id").agg(F.count_if(~other).alias("own"), F.count_if(other).alias("added"))


@query("G28_carried_attributes", """SELECT c.c_custkey AS script_id, count(*) AS n FROM customer c JOIN part ON p_partkey % 1000 = c.c_custkey - 1
    WHERE c.c_custkey % 3 <> 0 AND p_size % 2 = 0 AND p_type <> 'PROMO' GROUP BY 1""")
def carried_attributes(t):
    """Values cited by carried lines go to the next draft; even sizes are cited by one, promotion parts hold none in force."""
    made = _carried(t)
    return made["attributes"].groupBy("script_id").agg(F.count(F.lit(1)).alias("n"))


@query("G28_carried_entities", """SELECT c.c_custkey AS script_id, count(*) AS n, count(*) FILTER (p_size % 4 <> 0) AS cloned FROM customer c
    JOIN part ON p_partkey % 1000 = c.c_custkey - 1 WHERE c.c_custkey % 3 <> 0 AND p_size % 2 = 0 AND p_type <> 'PROMO' GROUP BY 1""")
def carried_entities(t):
    """An entity that the draft already has by type and name takes the values; any other is cloned."""
    made = _carried(t)
    clones = made["entities"].groupBy("script_id").agg(F.count(F.lit(1)).alias("cloned"))
    return made["entity_map"].groupBy("script_id").agg(F.count(F.lit(1)).alias("n")).join(clones, "script_id", "left").na.fill(0, ["cloned"])


@query("G28_carried_cache", """SELECT -o_orderkey - 1 AS scene_id, 'h' || o_orderkey AS input_hash FROM orders WHERE o_orderstatus = 'F'""")
def carried_cache(t):
    return _carried(t)["cache"].select("scene_id", "input_hash")


def _carried(t):
    pairs = t.scripts.filter("predecessor_script_id IS NOT NULL").select("script_id", F.col("predecessor_script_id").alias("old_script_id"))
    scenes = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("old_scene_id"), (-F.col("o_orderkey") - 1).alias("new_scene_id"))
    units = t.part.filter("p_size % 2 = 0").select(F.concat(F.lit("u"), "p_partkey").alias("old_unit_id"),
                                                  F.concat(F.lit("n"), "p_partkey").alias("new_unit_id"))
    own = t.part.select(F.col("p_partkey").alias("entity_id"), (F.col("p_partkey") % 1000).alias("script_id"), F.col("p_type").alias("entity_type"),
                        F.col("p_name").alias("canonical_name"), F.concat_ws("/", "p_name", "p_partkey").alias("normalized_name"))
    there = own.join(t.part.filter("p_size % 4 = 0").select(F.col("p_partkey").alias("entity_id")), "entity_id", "left_semi").withColumns({
        "script_id": F.col("script_id") + 1, "entity_id": -F.col("entity_id")})
    attributes = t.part.select(F.col("p_partkey").alias("attribute_id"), F.col("p_partkey").alias("entity_id"), F.lit("size").alias("key"),
                               F.col("p_size").cast("string").alias("value"), F.concat(F.lit("u"), "p_partkey").alias("source_unit_id"),
                               (F.col("p_type") != "PROMO").alias("active"))
    cache = t.orders.select(F.col("o_orderkey").alias("scene_id"), F.concat(F.lit("h"), "o_orderkey").alias("input_hash"), F.lit("v").alias(
        "prompt_version"), F.lit("m").alias("model_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return drafts.carry_graph(pairs, scenes, units, {"assertions": t.assertions.filter("scene_id < 0"), "entities": own.unionByName(
        there.select(*own.columns)), "attributes": attributes, "cache": cache})


@query("G28_carried_speakers", """SELECT conv_id || '-' || turn || 'n' AS unit_id, CASE role WHEN 'user' THEN -1 ELSE -2 END AS speaker_entity_id
    FROM conversations WHERE role <> 'system'""")
def carried_speakers(t):
    unit = F.concat_ws("-", "conv_id", "turn")
    old = t.conversations.select(unit.alias("unit_id"), F.expr("CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END").alias("speaker_entity_id"))
    pairs = t.conversations.select(unit.alias("old_unit_id"), F.concat(unit, F.lit("n")).alias("new_unit_id"))
    moved = t.conversations.select(F.expr("CASE role WHEN 'user' THEN 1 ELSE 2 END").alias("old_entity_id")).distinct().withColumn(
        "entity_id", -F.col("old_entity_id"))
    return drafts.carry_speakers(pairs, old, moved)


@query("G32_blocked_reports", """SELECT o_custkey AS script_id, count(*) AS unread FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'
    AND o_orderkey % 3 <> 0 GROUP BY 1""")
def blocked(t):
    scenes = t.scenes.join(t.orders.select(F.col("o_orderkey").alias("scene_id"), F.expr(
        "CASE o_orderstatus WHEN 'P' THEN 'unchanged' WHEN 'F' THEN 'modified' ELSE 'inserted' END").alias("lineage_kind")), "scene_id")
    cache = t.orders.select(F.col("o_orderkey").alias("scene_id"), F.when(F.col("o_orderkey") % 3 == 0, "completed").otherwise("running").alias("status"))
    return drafts.blocked_reports(scenes, cache)


@query("G33_line_changes", """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS unit_id, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE '' END
    AS before, l_returnflag AS text FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'
    AND (l_linenumber % 2 = 1 OR l_returnflag <> 'A')""")
def line_changes(t):
    """Even lines had a predecessor reading A; odd ones are new."""
    return _changed(t)[0].select("unit_id", "before", "text")


@query("G33_affected_forward", """WITH e AS (SELECT DISTINCT o_orderkey AS sc, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      WHERE o_orderstatus <> 'P' AND l_linestatus = 'O'), ed AS (SELECT DISTINCT l_orderkey AS sc FROM lineitem WHERE l_linenumber % 2 = 1 OR l_returnflag <> 'A')
    SELECT sc AS scene_id, count(DISTINCT x) AS entities FROM (SELECT sc, p AS x FROM e UNION ALL SELECT sc, -p FROM e WHERE p % 2 = 0)
    WHERE sc IN (SELECT sc FROM ed) GROUP BY 1""")
def affected_forward(t):
    """What the scene before touched counts too, under the entity that carries it on: even parts have one."""
    return _changed(t)[1].groupBy("scene_id").agg(F.count_distinct("entity_id").alias("entities"))


def _changed(t):
    scenes = t.orders.select(
        F.col("o_orderkey").alias("scene_id"), F.lit(0).alias("script_id"), (-F.col("o_orderkey") - 1).alias("predecessor_scene_id"),
        F.expr("CASE o_orderstatus WHEN 'P' THEN 'unchanged' WHEN 'F' THEN 'modified' ELSE 'inserted' END").alias("lineage_kind"))
    lines = lined(t).select(F.col("id").alias("unit_id"), F.col("l_orderkey").alias("scene_id"), F.col("l_returnflag").alias("text"),
                            F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("b"), "id")).alias("predecessor_unit_id"))
    olds = lines.filter("predecessor_unit_id IS NOT NULL").select(
        F.col("predecessor_unit_id").alias("unit_id"), (-F.col("scene_id") - 1).alias("scene_id"), F.lit("A").alias("text"),
        F.lit(None).cast("string").alias("predecessor_unit_id"))
    facts = lined(t).select(F.col("id").alias("assertion_id"), F.lit(None).cast("long").alias("subject_entity_id"),
                            F.col("l_partkey").alias("object_entity_id"), (F.col("l_linestatus") == "O").alias("active"),
                            F.col("l_orderkey").alias("unit_scene_id"))
    past = facts.withColumns({"assertion_id": F.concat(F.lit("b"), "assertion_id"), "unit_scene_id": -F.col("unit_scene_id") - 1})
    entities = t.part.filter("p_partkey % 2 = 0").select(F.lit(0).alias("script_id"), (-F.col("p_partkey")).alias("entity_id"),
                                                        F.col("p_partkey").alias("predecessor_entity_id"))
    return drafts.changed_lines(scenes, lines.unionByName(olds), facts.unionByName(past), entities)


def _omissions(t):
    """Each order of low priority was omitted by a change set that removed its facts; every third was never accepted."""
    low = t.orders.filter("o_orderpriority = '5-LOW'")
    sets = low.select(F.col("o_orderkey").alias("change_set_id"), F.lit("omit_scene").alias("kind"),
                      F.when(F.col("o_orderkey") % 3 == 0, "pending").otherwise("accepted").alias("status"), F.col("o_orderdate").alias("accepted_at"))
    facts = t.facts.join(low.select(F.col("o_orderkey").alias("scene_id")), "scene_id", "left_semi")
    steps = changes.omission_operations(facts, low.select(F.col("o_orderkey").alias("scene_id")))
    operations = steps.select(F.col("scene_id").alias("change_set_id"), "sequence_index", "operation_type",
                              F.when(F.col("operation_type") == "remove_assertion", "assertion").otherwise("scene").alias("target_type"), "target_id",
                              F.lit(None).cast("string").alias("before_json"), F.lit(None).cast("string").alias("after_json"))
    findings = low.select(F.col("o_orderkey").alias("change_set_id"), F.lit("open").alias("status"))
    asked = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("scene_id"))
    assertions = t.facts.withColumn("active", F.lit(False))
    return changes.restore_scenes(asked, t.scenes.select("scene_id", "omitted"), sets, operations, assertions, findings)


BACK = "o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0"


@query("G37_restored_scenes", f"SELECT o_orderkey AS scene_id, o_orderpriority = '5-LOW' AND NOT ({BACK}) AS omitted FROM orders")
def restored_scenes(t):
    return _omissions(t)["scenes"]


@query("G37_restored_facts", with_("facts", then=f"""SELECT scene_id, count(*) AS n FROM facts WHERE scene_id IN (SELECT o_orderkey FROM orders WHERE {BACK}) GROUP BY 1"""))
def restored_facts(t):
    return _omissions(t)["assertions"].filter("active").groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))


@query("G37_restore_refusals", """SELECT o_orderkey AS scene_id, CASE WHEN o_orderpriority <> '5-LOW' THEN 'not_omitted' ELSE 'no_omission' END AS reason FROM orders
    WHERE o_orderkey % 2 = 0 AND (o_orderpriority <> '5-LOW' OR o_orderkey % 3 = 0)""")
def restore_refusals(t):
    return _omissions(t)["refused"]


@query("G37_reverted_sets", f"""SELECT o_orderkey AS change_set_id, CASE WHEN {BACK} THEN 'reverted' WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'accepted' END AS status,
    CASE WHEN {BACK} THEN 'resolved' ELSE 'open' END AS finding FROM orders WHERE o_orderpriority = '5-LOW'""")
def reverted_sets(t):
    made = _omissions(t)
    return made["change_sets"].select("change_set_id", "status").join(
        made["findings"].select("change_set_id", F.col("status").alias("finding")), "change_set_id")


@query("G38_inserted_scenes", with_("scenes", then="""SELECT script_id, scene_id, row_number() OVER (PARTITION BY script_id ORDER BY place, turn NULLS FIRST) - 1
      AS sequence_index FROM (SELECT script_id, scene_id, sequence_index AS place, NULL AS turn FROM scenes
      UNION ALL SELECT script_id, -scene_id - 1, CASE WHEN scene_id % 4 = 0 THEN -1 ELSE sequence_index END, -scene_id FROM scenes WHERE scene_id % 2 = 0)"""))
def inserted_scenes(t):
    """A new scene behind every even one; behind none where the number divides by four, that is at the front."""
    requests = t.scenes.filter("scene_id % 2 = 0").select(
        F.col("scene_id").alias("request_id"), "script_id", F.when(F.col("scene_id") % 4 != 0, F.col("scene_id")).alias("after"),
        (-F.col("scene_id") - 1).alias("scene_id"))
    rows = t.ordered_scenes.select("script_id", "scene_id", "sequence_index")
    return changes.insert_rows(rows, requests, "script_id", "scene_id")[0].select("script_id", "scene_id", "sequence_index")


@query("G38_refused_inserts", """SELECT o_orderkey AS request_id FROM orders WHERE o_orderkey % 5 = 1""")
def refused_inserts(t):
    """An anchor of another script, or one that is not there, refuses."""
    asked = t.scenes.select(F.col("scene_id").alias("request_id"), F.when(F.col("scene_id") % 10 == 1, F.col("script_id") + 1).otherwise(
        F.col("script_id")).alias("script_id"), F.when(F.col("scene_id") % 10 == 6, -F.col("scene_id") - 1).otherwise(F.col("scene_id")).alias("after"),
        (-F.col("scene_id") - 10 ** 12).alias("scene_id"))
    return changes.insert_rows(t.ordered_scenes.select("script_id", "scene_id", "sequence_index"), asked, "script_id", "scene_id")[1].select("request_id")


@query("G43_cancelled_jobs", """SELECT o_orderkey AS extraction_id, o_orderstatus AS status FROM orders WHERE NOT (o_orderstatus = 'P' AND o_custkey % 5 = 0)""")
def cancelled(t):
    cache = t.orders.select(F.col("o_orderkey").alias("extraction_id"), F.col("o_custkey").alias("run_id"), F.when(
        F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_orderstatus")).alias("status"))
    runs = t.orders.filter("o_custkey % 5 = 0").select(F.col("o_custkey").alias("run_id")).distinct()
    return build.cancel(cache, runs).select("extraction_id", F.when(F.col("status") == "pending", "P").otherwise(F.col("status")).alias("status"))


#: Every rule set on frames laid out from the given tables: name to (rules, columns, rows broken).
RULE_SETS = {
    "attribute": ("lineitem", {"provenance": "CASE l_returnflag WHEN 'A' THEN 'model' WHEN 'N' THEN 'user' ELSE 'nobody' END", "confidence": "l_tax * 15",
                               "evidence_start": "l_linenumber - 2", "source_unit_id": "CASE WHEN l_linestatus = 'O' THEN 'u' END"},
                  {"provenance_vocabulary": "l_returnflag = 'R'", "confidence_range": "NOT (l_tax * 15 BETWEEN 0 AND 1)",
                   "evidence_non_negative": "l_linenumber < 2", "model_needs_evidence": "l_returnflag = 'A' AND l_linestatus <> 'O'"}),
    "unit": ("conversations", {"unit_type": "CASE role WHEN 'user' THEN 'dialogue' WHEN 'assistant' THEN 'action' ELSE 'song' END",
                               "parser_method": "CASE WHEN turn % 2 = 0 THEN 'rule' ELSE 'guess' END", "sequence_index": "turn - 1", "parser_confidence": "turn / 4.0"},
             {"unit_type_vocabulary": "role NOT IN ('user', 'assistant')", "parser_method_vocabulary": "turn % 2 = 1", "index_non_negative": "turn < 1",
              "confidence_range": "turn > 4"}),
    "scene": ("orders", {"sequence_index": "o_orderkey % 7 - 1", "current_version": "o_orderkey % 5 - 2"},
              {"index_non_negative": "o_orderkey % 7 < 1", "version_non_negative": "o_orderkey % 5 < 2"}),
    "script": ("customer", {"import_status": "CASE WHEN c_nationkey < 5 THEN 'lost' ELSE 'accepted' END", "graph_status": "CASE WHEN c_nationkey > 20 THEN 'odd' ELSE 'ready' END",
                            "current_version": "c_nationkey - 1"},
               {"import_status_vocabulary": "c_nationkey < 5", "graph_status_vocabulary": "c_nationkey > 20", "version_non_negative": "c_nationkey < 1"}),
    "anchor": ("lineitem", {"page_number": "l_linenumber - 1", "start_offset": "l_linenumber - 3"},
               {"page_positive": "l_linenumber < 2", "start_non_negative": "l_linenumber < 3"}),
    "call": ("events", {"purpose": "CASE event_type WHEN 'view' THEN 'extract' WHEN 'click' THEN 'judge' ELSE event_type END",
                        "outcome": "CASE WHEN user_id % 2 = 0 THEN 'ok' ELSE 'lost' END", "input_tokens": "user_id % 3 - 1", "output_tokens": "1"},
             {"purpose_vocabulary": "event_type NOT IN ('view', 'click')", "outcome_vocabulary": "user_id % 2 = 1", "tokens_non_negative": "user_id % 3 = 0"}),
    "change": ("orders", {"kind": "CASE o_orderstatus WHEN 'F' THEN 'undo' ELSE 'whim' END", "status": "CASE WHEN o_custkey % 2 = 0 THEN 'pending' ELSE 'lost' END"},
               {"kind_vocabulary": "o_orderstatus <> 'F'", "status_vocabulary": "o_custkey % 2 = 1"}),
    "operation": ("lineitem", {"operation_type": "CASE l_returnflag WHEN 'A' THEN 'add_assertion' ELSE 'dance' END"}, {"operation_vocabulary": "l_returnflag <> 'A'"}),
    "finding": ("lineitem", {"status": "CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'shut' END"}, {"status_vocabulary": "l_linestatus <> 'O'"}),
    "entity": ("part", {"entity_type": "CASE p_type WHEN 'PROMO' THEN 'ghost' ELSE 'prop' END"}, {"entity_type_vocabulary": "p_type = 'PROMO'"}),
    "run": ("orders", {"status": "CASE o_orderstatus WHEN 'F' THEN 'ready' ELSE 'odd' END"}, {"status_vocabulary": "o_orderstatus <> 'F'"}),
    "job": ("orders", {"status": "CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'odd' END"}, {"status_vocabulary": "o_orderstatus <> 'F'"}),
}


@query("P9_every_rule_set", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS rules, '{rule}' AS rule, count(*) FILTER ({test}) AS n FROM {table}" for name, (table, _, tests) in RULE_SETS.items()
    for rule, test in tests.items()) + ") WHERE n > 0")
def every_rule_set(t):
    out = None
    for name, (table, columns, tests) in RULE_SETS.items():
        rules = getattr(quality, f"{name.upper()}_RULES")
        assert set(rules) == set(tests)
        rows = quality.violations(getattr(t, table).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]), rules)
        part = rows.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("rules"), "rule", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("P9_passing_rows", """SELECT o_orderkey AS scene_id FROM orders WHERE o_orderkey % 7 >= 1 AND o_orderkey % 5 >= 2""")
def passing_rows(t):
    scenes = t.orders.selectExpr("o_orderkey AS scene_id", "o_orderkey % 7 - 1 AS sequence_index", "o_orderkey % 5 - 2 AS current_version")
    return quality.passing(scenes, quality.SCENE_RULES).select("scene_id")


@query("P10_table_duplicates", """SELECT 'units' AS tbl, l_orderkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY 2, 3 HAVING count(*) > 1
    UNION ALL SELECT 'entity_attributes', l_partkey, l_linenumber, count(*) FROM lineitem WHERE l_linestatus = 'O' GROUP BY 2, 3 HAVING count(*) > 1""")
def table_duplicates(t):
    units = t.lineitem.selectExpr("l_orderkey AS scene_id", "l_linenumber AS sequence_index")
    values = t.lineitem.selectExpr("l_partkey AS entity_id", "l_linenumber AS key", "l_linestatus = 'O' AS active")
    return quality.table_duplicates("units", units).selectExpr("'units' AS tbl", "scene_id AS a", "sequence_index AS b", "n").unionByName(
        quality.table_duplicates("entity_attributes", values).selectExpr("'entity_attributes' AS tbl", "entity_id AS a", "key AS b", "n"))

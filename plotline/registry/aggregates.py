"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import aggregates as A
from plotline.operators import joins as J
from plotline.operators import ledger, mentions
from plotline.registry import query
from plotline.registry.joins import FINDINGS
from plotline.sources.tables import SQL, with_

RATES = """rates AS (SELECT * FROM (VALUES ('small', 0.000001, 0.000004), ('large', 0.00001, 0.00004))
    r(model_id, input_rate, output_rate))"""


def rates(t):
    """The price list: one row per priced model."""
    return t.spark.createDataFrame([("small", 1e-6, 4e-6), ("large", 1e-5, 4e-5)],
                                   "model_id string, input_rate double, output_rate double")


@query("A1_grouped_counts", with_("scripts", "scenes", "facts", "assertions", then="""
    SELECT script_id, coalesce(s.n, 0) AS scenes, coalesce(a.n, 0) AS assertions FROM scripts
    LEFT JOIN (SELECT script_id, count(*) AS n FROM scenes GROUP BY 1) s USING (script_id)
    LEFT JOIN (SELECT script_id, count(*) AS n FROM assertions WHERE active GROUP BY 1) a
    USING (script_id)"""))
def a1(t):
    return A.counts_with_zero(t.scripts.select("script_id"), "script_id", scenes=t.scenes,
                              assertions=t.assertions.filter("active"))


@query("A2_spend_ledger", with_("calls", then="""SELECT purpose, count(*) AS calls,
    CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens,
    CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
    CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS total_tokens
    FROM calls GROUP BY purpose"""))
def a2(t):
    return ledger.summary(t.model_calls)


@query("A3_pages_per_script", """SELECT conv_id AS script_id, CASE WHEN max(CASE WHEN role = 'system'
      THEN turn + 2 END) IS NOT NULL THEN max(CASE WHEN role = 'system' THEN turn + 2 END)
    ELSE greatest(1, CAST(round_even(sum(length(text)) / 800.0, 0) AS BIGINT)) END AS pages
    FROM conversations GROUP BY conv_id""")
def a3(t):
    return A.pages_per_script(t.conversations.select(
        F.col("conv_id").alias("script_id"), "text",
        F.expr("CASE WHEN role = 'system' THEN turn + 2 END").alias("page_number")))


@query("A4_citation_counts", with_("facts", then="""SELECT entity_id, count(*) AS cited FROM (
    SELECT assertion_id, subject_entity_id AS entity_id FROM facts WHERE active
      AND subject_entity_id IS NOT NULL UNION
    SELECT assertion_id, object_entity_id FROM facts WHERE active) GROUP BY 1"""))
def a4(t):
    from plotline.plans.duplicates import cited_counts
    return cited_counts(t.facts)


@query("A5_roster", with_("entities", then="""SELECT script_id, entity_type, count(*) AS n,
    array_to_string(list(canonical_name ORDER BY canonical_name)[1:5], ';') AS names
    FROM entities GROUP BY 1, 2"""))
def a5(t):
    return A.roster(t.entities, ["script_id", "entity_type"], 5).select(
        "script_id", "entity_type", F.col("count").alias("n"),
        F.array_join("names", ";").alias("names"))


ACTIONS_SQL = with_("scripts", "calls", then=", " + RATES + """, k AS (SELECT *, CASE
      WHEN purpose = 'extract' AND change_set_id IS NULL THEN 'build'
      WHEN purpose IN ('agent', 'draft') THEN 'agent'
      WHEN change_set_id IS NULL AND purpose <> 'query' THEN 'preview' END AS kind FROM calls),
    g AS (SELECT *, CASE WHEN kind IS NOT NULL AND (lag(created_at) OVER w IS NULL
      OR created_at > lag(created_at) OVER w + INTERVAL 1200 SECONDS) THEN created_at END AS opened
      FROM k WINDOW w AS (PARTITION BY kind, script_id ORDER BY created_at, call_id)),
    b AS (SELECT *, max(opened) OVER (PARTITION BY kind, script_id ORDER BY created_at, call_id) AS start
      FROM g),
    a AS (SELECT *, CASE WHEN kind IS NOT NULL THEN kind || '|' || script_id || '|' || start
      WHEN change_set_id IS NOT NULL THEN 'preview|' || change_set_id ELSE 'ask|' || call_id END AS ak,
      coalesce(kind, CASE WHEN change_set_id IS NOT NULL THEN 'preview' ELSE 'ask' END) AS kk FROM b),
    q AS (SELECT ak, kk, count(*) AS call_count, min(call_id) AS first_call,
      CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(reasoning_tokens, 0))
        AS BIGINT) AS tokens,
      sum(coalesce(input_tokens, 0) * input_rate + (coalesce(output_tokens, 0)
        + coalesce(reasoning_tokens, 0)) * output_rate) AS cost,
      count(DISTINCT scene_number) AS ns,
      string_agg(DISTINCT scene_number::VARCHAR, ', ' ORDER BY scene_number::VARCHAR) AS s,
      string_agg(DISTINCT a.model_id, ', ' ORDER BY a.model_id) AS model
      FROM a LEFT JOIN rates USING (model_id) GROUP BY 1, 2)
    SELECT first_call, call_count, tokens, round(cost, 9) AS cost_usd, model,
      CASE kk WHEN 'build' THEN 'Graph build' WHEN 'agent' THEN 'Ask' WHEN 'ask' THEN 'Ask the graph'
        ELSE 'Preview' END AS action,
      CASE WHEN ns = 0 THEN '' WHEN ns <= 4 THEN 'Scene ' || s ELSE call_count || ' scenes read' END
        AS detail FROM q""")


@query("A6_billable_actions", ACTIONS_SQL)
def a6(t):
    calls = t.model_calls
    return ledger.actions(calls, rates(t)).select(
        "first_call", "call_count", "tokens", F.round("cost_usd", 9).alias("cost_usd"), "model",
        "action", "detail")


@query("A7_call_cost", "WITH " + SQL["calls"] + ", " + RATES + """ SELECT call_id,
    round(coalesce(input_tokens, 0) * input_rate + (coalesce(output_tokens, 0)
      + coalesce(reasoning_tokens, 0)) * output_rate, 9) AS cost FROM calls LEFT JOIN rates
    USING (model_id)""")
def a7(t):
    return ledger.priced(t.model_calls, rates(t)).select("call_id", F.round("cost", 9).alias("cost"))


@query("A8_cost_by_model", "WITH " + SQL["calls"] + ", " + RATES + """ SELECT model_id, count(*) AS calls,
    round(sum(coalesce(input_tokens, 0)) * any_value(input_rate) + (sum(coalesce(output_tokens, 0))
      + sum(coalesce(reasoning_tokens, 0))) * any_value(output_rate), 6) AS cost
    FROM calls LEFT JOIN rates USING (model_id) GROUP BY model_id""")
def a8(t):
    return ledger.cost_by_model(t.model_calls, rates(t)).select(
        "model_id", "calls", F.round("cost", 6).alias("cost"))


@query("A9_library_counters", "WITH " + SQL["scripts"] + ", " + FINDINGS + ", " + SQL["facts"] + """
    SELECT 'scripts' AS counter, count(*) AS n FROM scripts
    UNION ALL SELECT 'recent', count(*) FROM scripts WHERE opened_at IS NOT NULL
    UNION ALL SELECT 'needs_review', count(*) FROM scripts WHERE import_status = 'needs_review'
    UNION ALL SELECT 'graphs', count(*) FROM scripts WHERE graph_status <> 'not_analysed'
    UNION ALL SELECT 'findings', count(*) FROM findings WHERE status = 'open'
    UNION ALL SELECT 'assertions', count(*) FROM facts WHERE active
    UNION ALL SELECT 'model_calls', count(*) FROM events""")
def a9(t):
    s = t.scripts
    return A.counters(
        scripts=(s, None), recent=(s, F.col("opened_at").isNotNull()),
        needs_review=(s, F.col("import_status") == "needs_review"),
        graphs=(s, F.col("graph_status") != "not_analysed"),
        findings=(J.findings(t), F.col("status") == "open"),
        assertions=(t.facts, F.col("active")), model_calls=(t.model_calls, None))


@query("A10_deletion_preview", with_("scripts", "scenes", "facts", "assertions", then="""
    SELECT script_id, 'scenes' AS "table", count(*) AS n FROM scenes
      SEMI JOIN (SELECT * FROM scripts WHERE graph_status = 'ready') USING (script_id) GROUP BY 1
    UNION ALL SELECT script_id, 'assertions', count(*) FROM assertions
      SEMI JOIN (SELECT * FROM scripts WHERE graph_status = 'ready') USING (script_id) GROUP BY 1"""))
def a10(t):
    return A.deletion_preview(t.scripts.filter("graph_status = 'ready'"), {
        "scenes": (t.scenes, "script_id"), "assertions": (t.assertions, "script_id")})


@query("A11_run_roll_up", """WITH j AS (SELECT o_custkey AS run_id, count(*) AS total,
      count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed,
      count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '5-LOW') AS open FROM orders GROUP BY 1)
    SELECT c_custkey AS run_id, coalesce(done, 0) AS completed, coalesce(failed, 0) AS failed,
      coalesce(open, 0) AS pending, CASE WHEN c_acctbal < 0 THEN 'cancelled'
      WHEN coalesce(open, 0) > 0 THEN CASE WHEN done > 0 THEN 'partially_ready' ELSE 'running' END
      WHEN coalesce(failed, 0) > 0 THEN CASE WHEN done > 0 THEN 'partially_ready' ELSE 'failed' END
      ELSE 'ready' END AS status FROM customer LEFT JOIN j ON run_id = c_custkey""")
def a11(t):
    from plotline.plans.build import roll_up
    runs = t.customer.select(F.col("c_custkey").alias("run_id"), F.expr(
        "CASE WHEN c_acctbal < 0 THEN 'cancelled' ELSE 'running' END").alias("status"))
    jobs = t.orders.select(F.col("o_custkey").alias("run_id"), F.expr(
        "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' "
        "WHEN o_orderpriority = '5-LOW' THEN 'pending' ELSE 'cancelled' END").alias("status"))
    return roll_up(runs, jobs).select(
        "run_id", F.col("completed_scenes").alias("completed"), F.col("failed_scenes").alias("failed"),
        F.col("open_scenes").alias("pending"), F.col("new_status").alias("status"))


@query("A12_read_variance", with_("calls", then="""SELECT script_id, count(*) AS reads,
    max(output_tokens) - min(output_tokens) AS spread FROM (SELECT *, row_number() OVER (
      PARTITION BY script_id ORDER BY created_at DESC, call_id DESC) AS k FROM calls
      WHERE purpose = 'extract' AND outcome <> 'cached') WHERE k <= 5 GROUP BY 1 HAVING count(*) >= 2"""))
def a12(t):
    calls = t.model_calls.withColumn("scene_id", F.col("script_id")).withColumn(
        "read_count", F.col("output_tokens"))
    return ledger.variance(calls).select("script_id", "reads", "spread")


@query("A12_variance_alerts", with_("calls", then="""SELECT script_id, spread FROM (SELECT script_id, count(*) AS reads,
    max(output_tokens) - min(output_tokens) AS spread FROM (SELECT *, row_number() OVER (
      PARTITION BY script_id ORDER BY created_at DESC, call_id DESC) AS k FROM calls
      WHERE purpose = 'extract' AND outcome <> 'cached') WHERE k <= 5 GROUP BY 1) WHERE reads >= 2 AND spread > 3"""))
def a12_alerts(t):
    calls = t.model_calls.withColumns({"scene_id": F.col("script_id"), "read_count": F.col("output_tokens")})
    return ledger.variance_alerts(calls).select("script_id", "spread")


@query("A11_run_progress", with_("calls", then=", " + RATES + """, r AS (SELECT c_custkey AS run_id, c_custkey AS script_id,
      TIMESTAMP '2024-01-01' + to_days(CAST(c_nationkey AS INTEGER)) AS started_at FROM customer),
    w AS (SELECT run_id, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(reasoning_tokens, 0)) AS tokens,
      sum(coalesce(input_tokens, 0) * input_rate + (coalesce(output_tokens, 0) + coalesce(reasoning_tokens, 0)) * output_rate) AS cost
      FROM r JOIN calls ON calls.script_id = r.script_id AND purpose = 'extract' AND created_at >= started_at LEFT JOIN rates USING (model_id) GROUP BY 1),
    g AS (SELECT o_custkey AS run_id, count(*) AS assertions FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT run_id, coalesce(assertions, 0) AS assertions, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, round(coalesce(cost, 0), 6) AS cost
    FROM r LEFT JOIN w USING (run_id) LEFT JOIN g USING (run_id)"""))
def a11_progress(t):
    from plotline.plans.build import progress
    runs = t.customer.select(F.col("c_custkey").alias("run_id"), F.col("c_custkey").alias("script_id"), F.expr(
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(c_nationkey AS INT))").alias("started_at"))
    written = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("run_id"))
    return progress(runs, t.model_calls, rates(t), written).select(
        "run_id", "assertions", "tokens", F.round("cost", 6).alias("cost"))


@query("A13_entity_coverage", """SELECT w AS wanted, l_orderkey AS scene, count(DISTINCT (l_linenumber,
      l_returnflag, p_name)) AS units, count(DISTINCT l_returnflag) AS predicates, min(l_linenumber) AS first_unit
    FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) v JOIN part ON contains(p_name, w)
    JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2""")
def a13(t):
    """Every word that names of parts use, looked for in all names."""
    asked = t.part.select(F.explode(F.split("p_name", " ")).alias("name")).distinct().withColumn("name_id", F.col("name"))
    texts = t.part.select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("text"))
    named = mentions.substring_hits(texts, asked).select(
        F.col("text_id").alias("p_partkey"), F.col("text").alias("p_name"), F.col("name").alias("wanted")).distinct()
    cited = t.lineitem.join(named, F.col("l_partkey") == F.col("p_partkey")).select(
        "wanted", F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("unit_id"),
        F.col("l_returnflag").alias("predicate"), F.col("p_name").alias("line"),
        F.lit("").alias("subject_label"), F.col("p_name").alias("object_label"))
    return A.coverage(cited, F.col("wanted"))


@query("A14_applied_summary", """WITH o AS (SELECT l_suppkey AS change_set_id, CASE l_linenumber % 4
      WHEN 0 THEN 'Text rewritten' WHEN 1 THEN 'Entity created' WHEN 2 THEN 'Scene omitted' END AS label,
      CASE WHEN l_linenumber % 4 = 3 THEN 'USES' WHEN l_linenumber > 4 THEN 'REQUIRES' END AS p,
      CASE WHEN l_quantity < 45 THEN CAST(CAST(l_quantity AS INTEGER) % 10 AS VARCHAR) ELSE '—' END AS scene
      FROM lineitem)
    SELECT change_set_id, scene, count(*) AS operations,
      coalesce(string_agg(DISTINCT label, ', ' ORDER BY label), 'Graph updated') AS applied,
      coalesce(string_agg(DISTINCT p, ', ' ORDER BY p), '') AS predicate FROM o GROUP BY 1, 2""")
def a14(t):
    operations = t.lineitem.select(
        F.col("l_suppkey").alias("change_set_id"),
        F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'set_unit_text' WHEN 1 THEN 'create_entity' "
               "WHEN 2 THEN 'set_scene_omitted' ELSE 'add_assertion' END").alias("operation_type"),
        F.expr("CASE WHEN l_linenumber % 4 = 3 THEN 'uses' WHEN l_linenumber > 4 THEN 'requires' END")
        .alias("predicate"),
        F.expr("CASE WHEN l_quantity < 45 THEN CAST(CAST(l_quantity AS INT) % 10 AS STRING) END")
        .alias("scene"))
    return A.applied_summary(operations)


@query("A15_screenplay_likeness", """WITH u AS (SELECT conv_id, CASE role WHEN 'user' THEN 'character'
      WHEN 'assistant' THEN 'dialogue' ELSE 'action' END AS k, length(text) AS n FROM conversations),
    s AS (SELECT conv_id, count(*) AS scenes, count(*) FILTER (k = 'character') AS c,
      count(*) FILTER (k = 'dialogue') AS d, avg(n) FILTER (k = 'action') AS m FROM u GROUP BY 1),
    g AS (SELECT *, (CASE WHEN scenes >= 3 THEN 35 ELSE 0 END + CASE WHEN c > 0 AND d > 0 THEN 35 ELSE 0
      END + CASE WHEN d / scenes >= 0.08 THEN 20 ELSE 0 END + CASE WHEN m <= 700 THEN 10 ELSE 0 END) / 100
      AS score FROM s)
    SELECT conv_id, round(score, 2) AS score, score >= 0.5 AS is_screenplay,
      score >= 0.5 AND score < 0.6 AS needs_review FROM g""")
def a15(t):
    units = t.conversations.select(F.col("conv_id").alias("doc_id"), "text", F.expr(
        "CASE role WHEN 'user' THEN 'character' WHEN 'assistant' THEN 'dialogue' ELSE 'action' END")
        .alias("unit_type"))
    return A.likeness(units.select("doc_id"), units).select(
        F.col("doc_id").alias("conv_id"), "score", "is_screenplay", "needs_review")


@query("A16_draft_kinds", """SELECT o_custkey AS script_id, count(*) FILTER (o_orderpriority = '1-URGENT')
      AS unchanged, count(*) FILTER (o_orderpriority = '2-HIGH') AS modified,
      count(*) FILTER (o_orderpriority = '3-MEDIUM') AS inserted,
      count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS deleted
    FROM orders GROUP BY 1""")
def a16(t):
    kind = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'unchanged' WHEN '2-HIGH' THEN 'modified' "
                  "WHEN '3-MEDIUM' THEN 'inserted' ELSE 'deleted' END")
    return A.draft_kinds(t.orders.select(F.col("o_custkey").alias("script_id"),
                                         kind.alias("lineage_kind")))


@query("A17_severity", """SELECT l_orderkey AS change_set_id, CASE max(CASE WHEN l_tax > 0.075 THEN 3
      WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)
      WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS severity
    FROM lineitem GROUP BY 1""")
def a17(t):
    diff = t.lineitem.select(F.col("l_orderkey").alias("change_set_id"), F.expr(
        "CASE l_returnflag WHEN 'R' THEN 'removed' WHEN 'A' THEN 'added' ELSE 'unchanged' END")
        .alias("state"))
    later = t.lineitem.filter("l_tax > 0.075").select(F.col("l_orderkey").alias("change_set_id"))
    return A.severity(diff, later)


@query("A18_open_findings", "WITH " + FINDINGS + """ SELECT script_id, count(DISTINCT finding_id) AS open,
    count(DISTINCT l_orderkey || '-' || l_linenumber) AS flagged_units FROM findings
    LEFT JOIN lineitem ON l_orderkey = finding_id AND l_returnflag = 'A' WHERE status = 'open'
    GROUP BY 1""")
def a18(t):
    evidence = t.lineitem.filter("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("finding_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit_id"))
    return A.open_findings(J.findings(t), evidence)


@query("A19_facts_citing", with_("facts", then="""SELECT source_unit_id, count(*) AS facts FROM (
    SELECT source_unit_id FROM facts WHERE active UNION ALL
    SELECT l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_quantity > 40) GROUP BY 1"""))
def a19(t):
    attributes = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_unit_id"),
                                   (F.col("l_quantity") > 40).alias("active"))
    return A.facts_citing(t.facts, attributes)


GROUNDED_SQL = with_("facts", then="""SELECT k.scene_id, grounded_in, total_units,
      round(mc + 1e-9, 2) AS mean_confidence, array_to_string(list_sort(names)[1:8], ';') AS entities
    FROM (SELECT scene_id, count(*) AS grounded_in, count(DISTINCT source_unit_id) AS total_units,
      avg(confidence) AS mc FROM facts WHERE active GROUP BY 1) k
    JOIN (SELECT scene_id, list(DISTINCT n) AS names FROM (SELECT scene_id, p_name AS n FROM facts
      JOIN part ON p_partkey = object_entity_id WHERE active UNION ALL
      SELECT scene_id, 'Sc ' || scene_id FROM facts WHERE active) GROUP BY 1) n USING (scene_id)""")


def grounded(t):
    matched = t.facts.filter("active").join(
        t.part.select(F.col("p_partkey").alias("object_entity_id"), F.col("p_name").alias("object_label")),
        "object_entity_id").select(
        "scene_id", F.col("assertion_id").alias("item_rank"), F.col("source_unit_id").alias("unit_id"),
        F.col("object_label").alias("unit_text"), "predicate",
        F.concat(F.lit("Sc "), "scene_id").alias("subject_label"), "object_label",
        (F.col("confidence") + 1e-9).alias("confidence"), F.lit(False).alias("asks_presence"))
    return matched


@query("A20_grounding_metrics", GROUNDED_SQL)
def a20(t):
    metrics, _ = A.grounding(grounded(t), "scene_id")
    return metrics.withColumn("entities", F.array_join("entities", ";"))


@query("A20_sample_units", with_("facts", then="""SELECT scene_id, source_unit_id AS unit_id, k AS place FROM (SELECT scene_id, source_unit_id,
      row_number() OVER (PARTITION BY scene_id ORDER BY first) AS k FROM (SELECT scene_id, source_unit_id, min(assertion_id) AS first
      FROM facts WHERE active GROUP BY 1, 2)) WHERE k <= 6"""))
def a20_units(t):
    _, cited = A.grounding(grounded(t), "scene_id")
    return cited.select("scene_id", "unit_id", F.col("place").cast("long").alias("place"))


@query("A21_first_seen_labels", """SELECT user_id, event_type, epoch_us(min(ts)) AS first_at FROM events
    GROUP BY 1, 2""")
def a21(t):
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return A.first_seen(t.events.withColumn("at", at), ["user_id"], "at", "event_type")


@query("A22_validation_tally", """SELECT l_orderkey AS call_id,
      count(*) FILTER (r IS NULL AND what = 'entity') AS entities,
      count(*) FILTER (r IS NULL AND what = 'assertion') AS assertions,
      count(*) FILTER (r IS NOT NULL) AS rejected, coalesce(string_agg(DISTINCT r, ',' ORDER BY r), '')
      AS reasons
    FROM (SELECT l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'entity' ELSE 'assertion' END AS what,
      CASE WHEN l_tax > 0.065 THEN 'bad_confidence' WHEN l_discount > 0.085 THEN 'unreferenced' END AS r
      FROM lineitem) GROUP BY 1""")
def a22(t):
    items = t.lineitem.select(
        F.col("l_orderkey").alias("call_id"),
        F.when(F.col("l_linestatus") == "O", "entity").otherwise("assertion").alias("what"),
        F.expr("CASE WHEN l_tax > 0.065 THEN 'bad_confidence' WHEN l_discount > 0.085 "
               "THEN 'unreferenced' END").alias("reason"))
    return A.validation_tally(items)


@query("A23_distinct_two_phase", with_("facts", then="""SELECT predicate, count(DISTINCT object_entity_id)
    AS entities, count(DISTINCT scene_id) AS scenes FROM facts GROUP BY 1"""))
def a23(t):
    return t.facts.groupBy("predicate").agg(
        F.count_distinct("object_entity_id").alias("entities"),
        F.count_distinct("scene_id").alias("scenes"))

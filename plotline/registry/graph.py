"""Graph dataflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.plans import continuity, diff, retrieval, rules, views
from plotline.registry import query
from plotline.session import durable
from plotline.sources.tables import with_

EDGES = """e AS (SELECT l_orderkey AS cs, l_returnflag AS p, CAST(l_partkey AS VARCHAR) AS o, p_type AS ty,
      l_linestatus AS side, max_by(round(1 - l_discount, 2), (l_linenumber, l_suppkey)) AS conf
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    d AS (SELECT coalesce(a.cs, b.cs) AS cs, coalesce(a.p, b.p) AS p, coalesce(a.o, b.o) AS o,
      coalesce(a.ty, b.ty) AS ty, a.conf AS ca, b.conf AS cb,
      CASE WHEN b.cs IS NULL THEN 'removed' WHEN a.cs IS NULL THEN 'added' ELSE 'unchanged' END AS st
      FROM (SELECT * FROM e WHERE side = 'F') a FULL JOIN (SELECT * FROM e WHERE side = 'O') b
      ON a.cs = b.cs AND a.p = b.p AND a.o = b.o),
    s AS (SELECT cs, p, ty, count(*) FILTER (st = 'removed') AS r, count(*) FILTER (st = 'added') AS ad,
      max(o) FILTER (st = 'removed') AS ro, max(o) FILTER (st = 'added') AS ao,
      max(ca) FILTER (st = 'removed') AS rc, max(cb) FILTER (st = 'added') AS ac
      FROM d GROUP BY 1, 2, 3),
    f AS (SELECT d.cs, d.p, d.o, NULL AS o2, d.st, ca, cb FROM d LEFT JOIN s USING (cs, p, ty)
      WHERE st = 'unchanged' OR NOT (r = 1 AND ad = 1)
      UNION ALL SELECT cs, p, ro, ao, 'changed', rc, ac FROM s WHERE r = 1 AND ad = 1)"""


def edge_sets(t):
    rows = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    none = F.lit(None).cast("string")
    edges = rows.select(
        F.col("l_orderkey").alias("change_set_id"), F.lit("scene").alias("subject_kind"),
        F.col("l_orderkey").cast("string").alias("subject_key"), F.col("l_returnflag").alias("predicate"),
        F.lit("entity").alias("object_kind"), F.col("l_partkey").cast("string").alias("object_key"),
        none.alias("subject_type"), F.col("p_type").alias("object_type"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_unit_id"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_returnflag").alias("assertion_id"),
        none.alias("manner"), F.struct("l_linenumber", "l_suppkey").alias("position"), "l_linestatus")
    return (edges.filter("l_linestatus = 'F'").drop("l_linestatus"),
            edges.filter("l_linestatus = 'O'").drop("l_linestatus"))


@query("G1_graph_diff", "WITH " + EDGES + """ SELECT cs AS change_set_id, p AS predicate, o AS object, o2 AS new_object,
    st AS state, ca AS confidence_before, cb AS confidence_after FROM f""")
def g1(t):
    return diff.diff_edges(*edge_sets(t)).select(
        "change_set_id", "predicate", F.col("object_key").alias("object"),
        F.col("new_object_key").alias("new_object"), "state",
        F.col("before.confidence").alias("confidence_before"),
        F.col("after.confidence").alias("confidence_after"))


@query("G2_ordered_operations", "WITH " + EDGES + """ SELECT cs AS change_set_id, row_number() OVER (PARTITION BY cs ORDER BY
      CASE st WHEN 'removed' THEN 0 WHEN 'changed' THEN 1 ELSE 2 END, p, o) - 1 AS sequence_index,
    CASE st WHEN 'removed' THEN 'remove_assertion' WHEN 'changed' THEN 'update_assertion' ELSE 'add_assertion' END
      AS operation_type, CASE WHEN st <> 'added' THEN cs || '-' || o || '-' || p END AS target_id,
    CASE WHEN st <> 'removed' THEN coalesce(o2, o) END AS after_object FROM f WHERE st <> 'unchanged'""")
def g2(t):
    return diff.to_operations(durable(diff.diff_edges(*edge_sets(t)))).select(
        "change_set_id", "sequence_index", "operation_type", "target_id",
        F.get_json_object("after_json", "$.object_ref").alias("after_object"))


@query("G6_orphaned_references", with_("facts", then=""", r AS (SELECT * FROM facts WHERE active AND confidence < 0.75
      AND predicate IN ('establishes', 'requires')),
    t AS (SELECT object_entity_id AS e, count(*) AS n FROM facts WHERE active AND predicate = 'establishes' GROUP BY 1),
    c AS (SELECT created_at::DATE AS cs, object_entity_id AS e, count(*) AS n FROM r WHERE predicate = 'establishes'
      GROUP BY 1, 2), l AS (SELECT cs, e FROM c JOIN t USING (e) WHERE c.n = t.n),
    u AS (SELECT assertion_id, scene_id, unnest(list_distinct([x FOR x IN [subject_entity_id, object_entity_id] IF x IS
      NOT NULL])) AS e FROM facts WHERE active AND predicate IN ('uses', 'requires'))
    SELECT strftime(cs, '%Y-%m-%d') AS change_set_id, e AS entity_id, count(*) AS uses, count(DISTINCT scene_id) AS scenes FROM l JOIN u USING (e)
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.assertion_id = u.assertion_id AND r.created_at::DATE = l.cs)
    GROUP BY 1, 2""").replace("\n, r AS", ", r AS"))
def g6(t):
    facts = t.facts.withColumn("in_scene", F.col("scene_id")).withColumn(
        "scene_label", F.col("scene_id").cast("string"))
    removed = facts.filter("active AND confidence < 0.75 AND predicate IN ('establishes', 'requires')").select(
        F.date_format("created_at", "yyyy-MM-dd").alias("change_set_id"), "assertion_id")
    return continuity.orphaned(removed, facts).groupBy("change_set_id", "entity_id").agg(
        F.count(F.lit(1)).alias("uses"), F.count_distinct("scene_label").alias("scenes"))


@query("G7_cast_renames", """WITH c AS (SELECT c_custkey AS id, c_nationkey AS script, c_mktsegment AS nm,
      CASE WHEN c_acctbal < 0 THEN 'BUILDING' ELSE c_mktsegment END AS nw FROM customer),
    n AS (SELECT script, nm, count(*) AS k FROM c GROUP BY 1, 2)
    SELECT id AS unit_id, nm AS old_label, nw AS new_label, k - 1 AS lines FROM c JOIN n USING (script, nm)
    WHERE nm <> nw""")
def g7(t):
    cues = t.customer.select(
        F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("script_id"),
        F.concat("c_mktsegment", F.lit(" (CONT'D)")).alias("text"),
        (F.col("c_custkey") % 9).cast("string").alias("scene_label"), "c_acctbal", "c_mktsegment")
    edits = cues.select("unit_id", "script_id", F.col("text").alias("current_text"), F.when(
        F.col("c_acctbal") < 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("proposed_text"))
    return continuity.cast_renames(edits, cues).select("unit_id", "old_label", "new_label", "lines")


@query("G8_continuity_packet", with_("scenes", "facts", "assertions", then=""", q AS (SELECT z.scene_id AS request_id, z.sequence_index AS origin, a.assertion_id,
      a.predicate, s.sequence_index, 100 + CASE WHEN predicate = 'uses' THEN 20 ELSE 0 END
      - 0.5 * least(abs(s.sequence_index - z.sequence_index), 50) AS score FROM assertions a JOIN scenes s USING (scene_id)
      JOIN scenes z ON z.script_id = a.script_id
      WHERE active AND EXISTS (SELECT 1 FROM facts f WHERE f.scene_id = z.scene_id AND (f.object_entity_id = a.object_entity_id
        OR f.object_entity_id = a.subject_entity_id)))
    SELECT request_id, assertion_id, k AS place, CASE WHEN sequence_index = origin THEN 'same_scene'
      WHEN sequence_index < origin THEN 'earlier_same_entity' ELSE 'later_same_entity' END AS relation FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, sequence_index, assertion_id) AS k
      FROM q) WHERE k <= 40""").replace("\n, q AS", ", q AS"))
def g8(t):
    scenes = t.ordered_scenes
    touched = t.facts.join(scenes.select("scene_id", "script_id", "sequence_index"), "scene_id")
    requests = touched.select(F.col("scene_id").alias("request_id"), "script_id", F.col("sequence_index").alias("origin_index"),
                              F.col("object_entity_id").alias("entity_id")).distinct()
    facts = t.assertions.withColumn("in_scene", F.col("scene_id"))
    return continuity.evidence(requests, facts, scenes, ["uses"]).select(
        "request_id", "assertion_id", F.col("place").cast("long").alias("place"), "relation")


@query("G9_question_packet", """WITH q AS (SELECT p_partkey AS question_id, p_brand AS script_id, CASE WHEN p_size < 20
      THEN 'Where is the ' || p_name || '?' WHEN p_size < 40 THEN 'which scenes show any '
      || string_split(p_name, ' ')[1] || ' things' ELSE 'which lines are listed' END AS text, p_name, p_size FROM part),
    f AS (SELECT p_brand AS script_id, p_partkey AS id, p_name, ' ' || p_name || ' requires ' || lower(p_type) || ' '
      AS edge FROM part),
    m AS (SELECT question_id, q.script_id, id, CASE WHEN q.p_size < 20 THEN 1 WHEN q.p_size < 40 THEN 2 ELSE 3 END AS tier
      FROM q JOIN f ON q.script_id = f.script_id AND CASE WHEN q.p_size < 20 THEN f.p_name = q.p_name
        WHEN q.p_size < 40 THEN contains(edge, ' ' || string_split(q.p_name, ' ')[1] || ' ') ELSE true END)
    SELECT question_id, id AS assertion_id, tier, n > 30 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY id)
      AS k, count(*) OVER (PARTITION BY question_id) AS n FROM m) WHERE k <= 30""")
def g9(t):
    questions = t.part.select(
        F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("script_id"), F.expr(
            "CASE WHEN p_size < 20 THEN 'Where is the ' || p_name || '?' WHEN p_size < 40 THEN 'which scenes show any ' "
            "|| split(p_name, ' ')[0] || ' things' ELSE 'which lines are listed' END").alias("text"))
    surfaces = t.part.groupBy(F.col("p_brand").alias("script_id"), F.col("p_name").alias("name")).agg(
        F.min("p_partkey").alias("entity_id"))
    edges = t.part.join(surfaces, (F.col("p_brand") == F.col("script_id")) & (F.col("p_name") == F.col("name"))).select(
        "script_id", F.col("p_partkey").alias("assertion_id"), F.col("entity_id").alias("subject_entity_id"),
        F.lit(None).cast("long").alias("object_entity_id"), F.col("p_name").alias("subject_label"),
        F.lit("requires").alias("predicate"), F.col("p_type").alias("object_label"))
    return retrieval.packets(questions, surfaces, edges, 30).select("question_id", "assertion_id", "tier", "truncated")


@query("G14_rule_graph", """WITH u AS (SELECT conv_id, turn, upper(role) AS name FROM conversations)
    SELECT conv_id AS scene_id, 'cast' AS entity_type, name, 'appears_in' AS predicate, min(turn) AS unit_id,
      count(*) AS lines, 0 AS start_at, length(name) AS end_at FROM u GROUP BY conv_id, name
    UNION ALL SELECT conv_id, 'location', 'ROOM ' || conv_id, 'occurs_at', -1, 1, 5, 10 + length(conv_id::VARCHAR)
    FROM (SELECT DISTINCT conv_id FROM conversations)""")
def g14(t):
    """First appearance and line count of each speaker per scene, and each scene's place."""
    cues = t.conversations.select(
        F.col("conv_id").alias("scene_id"), F.col("turn").alias("unit_id"), F.col("turn").alias("sequence_index"),
        F.lit("character").alias("unit_type"), F.concat(F.upper("role"), F.lit(" (V.O.)")).alias("text"))
    scenes = t.conversations.select(F.col("conv_id").alias("scene_id")).distinct().withColumn(
        "heading", F.concat(F.lit("INT. ROOM "), "scene_id", F.lit(" - NIGHT")))
    heads = scenes.select("scene_id", F.lit(-1).cast("long").alias("unit_id"),
                          F.lit(-1).cast("long").alias("sequence_index"),
                          F.lit("scene_heading").alias("unit_type"), F.col("heading").alias("text"))
    return rules.provided(cues.unionByName(heads), scenes).select(
        "scene_id", "entity_type", "name", "predicate", "unit_id", "lines",
        F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


ORDER_GRAPHS_SQL = with_("facts", then=""", g AS (SELECT * FROM facts WHERE active),
    s AS (SELECT DISTINCT o_orderkey AS rid, assertion_id FROM orders JOIN g ON subject_scene_id = o_orderkey
      UNION SELECT o_orderkey, assertion_id FROM orders JOIN g ON source_unit_id = o_orderkey || '-1'),
    n AS (SELECT assertion_id, unnest([subject_entity_id, object_entity_id]) AS e FROM g),
    h AS (SELECT DISTINCT rid, n2.assertion_id FROM s JOIN n USING (assertion_id) JOIN n n2 ON n2.e = n.e
      UNION SELECT * FROM s)
    SELECT rid AS request_id, count(*) FILTER (confidence >= 0.6) AS links, count(*) FILTER (confidence < 0.6) AS hidden
    FROM h JOIN g USING (assertion_id) GROUP BY 1""").replace("\n, g AS", ", g AS")


@query("G34_unit_graph", ORDER_GRAPHS_SQL)
def g34(t):
    """The graph around every order: its own facts and those of the entities they name."""
    return order_graphs(t)


def order_graphs(t):
    """Links and hidden facts around the first unit and the scene of every order."""
    requests = t.orders.select(
        F.col("o_orderkey").alias("request_id"), F.concat("o_orderkey", F.lit("-1")).alias("unit_id"),
        F.col("o_orderkey").alias("scene_id"))
    types = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"))
    links, hidden = views.unit_graph(requests, t.facts.drop("scene_id", "predicate", "created_at"), types, 0.6)
    shown = links.groupBy("request_id").agg(F.count(F.lit(1)).alias("links"))
    return hidden.join(shown, "request_id", "left").na.fill(0, ["links"])


@query("G34_unit_graph_all", ORDER_GRAPHS_SQL)
def g34_all(t):
    """The same graphs under the name they had when G34_unit_graph was cut."""
    return order_graphs(t)


@query("G35_script_graph", with_("scenes", "facts", "assertions", then=""", g AS (SELECT a.*, p_type FROM assertions a
      JOIN part ON p_partkey = object_entity_id WHERE active AND confidence >= 0.8
      AND p_type IN ('SMALL', 'PROMO') AND (subject_kind = 'scene' OR EXISTS (SELECT 1 FROM part x
        WHERE x.p_partkey = subject_entity_id AND x.p_type IN ('SMALL', 'PROMO')))),
    n AS (SELECT script_id, 'entity' AS k, object_entity_id AS id FROM g UNION SELECT script_id, 'entity',
      subject_entity_id FROM g WHERE subject_entity_id IS NOT NULL UNION SELECT script_id, 'scene', scene_id FROM scenes)
    SELECT script_id, nodes, coalesce(links, 0) AS links FROM (SELECT script_id, count(*) AS nodes FROM n GROUP BY 1)
    LEFT JOIN (SELECT script_id, count(*) AS links FROM g GROUP BY 1) USING (script_id)""").replace("\n, g AS", ", g AS"))
def g35(t):
    types = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"))
    nodes, links = views.script_graph(t.assertions, t.scenes, types, 0.8, ["SMALL", "PROMO"])
    n = nodes.groupBy("script_id").agg(F.count(F.lit(1)).alias("nodes"))
    k = links.groupBy("script_id").agg(F.count(F.lit(1)).alias("links"))
    return n.join(k, "script_id", "left").na.fill(0, ["links"])


@query("G36_entity_detail", with_("facts", then=""", n AS (SELECT assertion_id, source_unit_id, subject_scene_id, unnest(
      list_distinct([x FOR x IN [subject_entity_id, object_entity_id] IF x IS NOT NULL])) AS e FROM facts WHERE active)
    SELECT p_partkey AS entity_id, count(assertion_id) AS facts, count(DISTINCT subject_scene_id) AS scenes,
      min_by(source_unit_id, assertion_id) AS unit_id FROM part LEFT JOIN n ON e = p_partkey GROUP BY 1""")
       .replace("\n, n AS", ", n AS"))
def g36(t):
    entities = t.part.select(F.col("p_partkey").alias("entity_id"))
    units = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit_id"),
                              F.col("l_returnflag").alias("text")).dropDuplicates(["unit_id"])
    return views.entity_detail(t.facts, entities, units).select("entity_id", "facts", "scenes", "unit_id")


@query("G36_unit_requirements", with_("facts", then="""SELECT source_unit_id AS unit_id, predicate, p_name AS object_label,
    count(*) AS n FROM facts JOIN part ON p_partkey = object_entity_id WHERE active GROUP BY 1, 2, 3"""))
def g36_requirements(t):
    labels = t.part.select(F.lit("entity").alias("kind"), F.col("p_partkey").alias("node_id"),
                           F.col("p_name").alias("label"))
    return views.unit_requirements(t.facts, labels).groupBy("unit_id", "predicate", "object_label").agg(
        F.count(F.lit(1)).alias("n"))



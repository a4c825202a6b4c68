"""Drafts of one work."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.plans import drafts
from plotline.registry import query
from plotline.sources.tables import SQL, with_

# Drafts from the documents: copies share their longest line (of several, the last in
# order of text). The older draft of a pair is the lower id, the newer the next higher one.
DRAFTS = """g AS (SELECT doc_id, md5(max_by(x, (length(x), x))) AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
      GROUP BY 1),
    pr AS (SELECT doc_id AS new_doc, lag(doc_id) OVER (PARTITION BY h ORDER BY doc_id) AS old_doc FROM g
      QUALIFY old_doc IS NOT NULL),
    ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, trim(unnest(string_split(text, chr(10)))) AS t FROM documents)"""


def draft_pairs(t):
    """pair_id, old_doc, new_doc: each document with the next copy of it.

    The copies of one document may be very many, so the neighbour is found with
    the blocked scan, not one window per group of copies.
    """
    from plotline.operators import scans
    longest = F.array_max(F.transform(F.split("text", "\n"), lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))["x"]
    docs = t.documents.filter("text IS NOT NULL").select("doc_id", F.md5(longest).alias("h"))
    before = scans.Scan(docs, ["h"], [F.col("doc_id")]).previous({"old_doc": F.col("doc_id")}).done()
    return before.filter("old_doc IS NOT NULL").select(
        F.col("doc_id").alias("pair_id"), "old_doc", F.col("doc_id").alias("new_doc"))


def scene_frames(t):
    """Every line of a document as a scene of one unit, numbered where it is long."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    rows = rows.select("doc_id", "position", F.concat_ws("-", "doc_id", "position").alias("scene_id"),
                       F.when(F.char_length("line") > 400, F.col("position").cast("string")).alias("number"),
                       F.lit("INT. PAGE").alias("heading"), F.array("line").alias("texts"))
    pairs = draft_pairs(t)
    old = rows.join(pairs.select(F.col("old_doc").alias("doc_id"), "pair_id"), "doc_id").drop("doc_id")
    new = rows.join(pairs.select(F.col("new_doc").alias("doc_id"), "pair_id"), "doc_id").drop("doc_id")
    return old, new


@query("G25_exact_alignment", "WITH " + DRAFTS + """, o AS (SELECT new_doc AS p, pos, t, row_number() OVER (PARTITION BY new_doc, t ORDER BY pos) AS k
      FROM pr JOIN ln ON doc_id = old_doc), n AS (SELECT new_doc AS p, pos, t, row_number() OVER (PARTITION BY new_doc, t ORDER BY pos) AS k
      FROM pr JOIN ln ON doc_id = new_doc)
    SELECT o.p AS pair_id, count(*) AS pairs, CAST(sum(o.pos - 1) AS BIGINT) AS old_places, CAST(sum(n.pos - 1) AS BIGINT) AS new_places
    FROM o JOIN n USING (p, t, k) GROUP BY 1""")
def g25(t):
    found = drafts.exact_passes(*scene_frames(t))["pairs"].filter("method = 'content'")
    place = lambda c: F.sum(F.element_at(F.split(c, "-"), 2).cast("long"))
    return found.groupBy("pair_id").agg(F.count(F.lit(1)).alias("pairs"), place("old_id").alias("old_places"),
                                        place("new_id").alias("new_places"))


@query("G26_similar_alignment")
def g26(t):
    found = drafts.align(*scene_frames(t))
    return found["pairs"].groupBy("pair_id", "kind", "method").agg(F.count(F.lit(1)).alias("n"))


def line_units(t):
    return t.documents.select(F.col("doc_id").alias("scene_id"), F.posexplode(F.split("text", "\n")).alias(
        "sequence_index", "text")).withColumn("unit_id", F.concat_ws("-", "scene_id", "sequence_index"))


@query("G27_line_alignment")
def g27(t):
    pairs = draft_pairs(t).select(F.col("old_doc").alias("old_id"), F.col("new_doc").alias("new_id"))
    return drafts.align_lines(pairs, line_units(t)).groupBy("scene_pair").agg(
        F.count_if("same").alias("same"), F.count_if(~F.col("same")).alias("revised"))


@query("G28_carry_graph", with_("facts", "assertions", then=""", dp AS (SELECT c_custkey AS script_id, c_custkey - 1 AS old_script_id FROM customer
      WHERE c_custkey % 3 <> 0), ok AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    SELECT dp.script_id, count(*) AS facts, count(DISTINCT object_entity_id) AS objects FROM assertions a JOIN dp ON a.script_id = dp.old_script_id
      JOIN ok ON o_orderkey = scene_id WHERE active GROUP BY 1""").replace("\n, dp AS", ", dp AS"))
def g28(t):
    pairs = t.scripts.filter("predecessor_script_id IS NOT NULL").select(
        "script_id", F.col("predecessor_script_id").alias("old_script_id"))
    kept = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("old_scene_id"),
                                                         (-F.col("o_orderkey") - 1).alias("new_scene_id"))
    units = t.facts.select(F.col("scene_id").alias("old_scene_id"), F.col("source_unit_id").alias("old_unit_id")).distinct().join(
        kept, "old_scene_id").select("old_unit_id", F.concat(F.lit("n"), "old_unit_id").alias("new_unit_id"))
    entities = t.part.select(F.col("p_partkey").alias("entity_id"), F.lit(-1).cast("long").alias("script_id"),
                             F.col("p_type").alias("entity_type"), F.col("p_name").alias("canonical_name"),
                             F.concat_ws("/", "p_name", "p_partkey").alias("normalized_name"))
    attributes = t.spark.createDataFrame([], "attribute_id long, entity_id long, key string, value string, "
                                             "source_unit_id string, active boolean")
    made = drafts.carry_graph(pairs, kept, units, {"assertions": t.assertions, "entities": entities,
                                                   "attributes": attributes})
    return made["assertions"].groupBy("script_id").agg(F.count(F.lit(1)).alias("facts"),
                                                       F.count_distinct("object_entity_id").alias("objects"))


@query("G29_draft_chains", "WITH " + SQL["scripts"] + """ SELECT script_id, script_id - script_id % 3 AS root_id, script_id % 3 AS depth FROM scripts""")
def g29(t):
    return drafts.chain_of(t.scripts)


@query("G29_link_refusals", with_("scripts", "facts", "assertions", then="""SELECT s.script_id, s.script_id + 1 AS predecessor, CASE
      WHEN predecessor_script_id IS NOT NULL THEN 'already_linked' WHEN s.script_id + 1 < (SELECT count(*) FROM customer) THEN 'loop'
      WHEN a.script_id IS NOT NULL THEN 'has_graph' END AS reason FROM scripts s LEFT JOIN (SELECT DISTINCT script_id FROM assertions) a
      USING (script_id)"""))
def g29_refusals(t):
    scripts = t.scripts.join(drafts.chain_of(t.scripts), "script_id")
    asked = t.scripts.select("script_id", (F.col("script_id") + 1).alias("predecessor"))
    return drafts.link_refusals(asked, scripts, t.assertions)


@query("G29_draft_candidates", with_("scripts", then="""SELECT script_id AS candidate_id FROM scripts WHERE graph_status IN ('ready',
    'partially_ready') AND script_id NOT IN (SELECT predecessor_script_id FROM scripts WHERE predecessor_script_id IS NOT NULL)"""))
def g29_candidates(t):
    return drafts.candidates(t.scripts).select("candidate_id")


@query("G32_draft_report", """SELECT *, CASE WHEN lost_introductions > 0 THEN 'high' WHEN attribute_changes > 0 OR removed > 0 THEN 'medium' ELSE 'low' END
      AS severity FROM (WITH e AS (SELECT p_brand AS b, p_type AS ty, p_name AS nm, min(p_partkey) AS id, min_by(p_size, p_partkey) AS v FROM part
      GROUP BY 1, 2, 3),
    k AS (SELECT n.b, n.id AS nid, o.id AS oid, n.v AS nv, o.v AS ov FROM e n JOIN e o ON n.b = 'Brand#' || (CAST(substr(o.b, 7) AS INTEGER) + 1)
      AND n.ty = o.ty AND n.nm = o.nm),
    f AS (SELECT l_partkey AS id, bool_or(l_returnflag = 'N') AS intro, bool_or(l_returnflag = 'A') AS used FROM lineitem
      WHERE l_linestatus = 'O' AND l_returnflag <> 'R' GROUP BY 1)
    SELECT d.b AS script_pair, (SELECT count(*) FROM k WHERE k.b = d.b) AS kept, (SELECT count(*) FROM e WHERE e.b = d.b) - (SELECT count(*) FROM k
      WHERE k.b = d.b) AS added, (SELECT count(*) FROM e o JOIN f USING (id) WHERE d.b = 'Brand#' || (CAST(substr(o.b, 7) AS INTEGER) + 1) AND NOT
      EXISTS (SELECT 1 FROM k WHERE k.oid = o.id AND k.b = d.b)) AS removed, (SELECT count(*) FROM k WHERE k.b = d.b AND nv <> ov) AS attribute_changes,
      (SELECT count(*) FROM k JOIN f x ON x.id = oid AND x.intro JOIN f y ON y.id = nid AND NOT y.intro AND y.used WHERE k.b = d.b)
        AS lost_introductions FROM (SELECT DISTINCT b FROM e WHERE b <> 'Brand#1') d)""")
def g32(t):
    e = t.part.groupBy(F.col("p_brand").alias("b"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("normalized_name")).agg(
        F.min("p_partkey").alias("entity_id"), F.min_by("p_size", "p_partkey").alias("value"))
    number = F.substring("b", 7, 9).cast("int")
    new = e.withColumn("script_pair", F.col("b")).withColumns({"predecessor_entity_id": F.lit(None).cast("long"),
                                                              "alias_key": F.lit("-")})
    new = new.filter("b <> 'Brand#1'")
    old = e.withColumn("script_pair", F.concat(F.lit("Brand#"), number + 1)).join(
        new.select("script_pair").distinct(), "script_pair", "left_semi")
    aliases = old.withColumn("normalized_alias", F.lit("none"))
    attributes = e.select("entity_id", F.lit("size").alias("key"), F.col("value").cast("string").alias("value"), F.lit(True).alias("active"))
    facts = t.lineitem.filter("l_returnflag <> 'R'").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("assertion_id"), F.lit(None).cast("long").alias("subject_entity_id"),
        F.col("l_partkey").alias("object_entity_id"), F.when(F.col("l_returnflag") == "N", "establishes").otherwise("requires")
        .alias("predicate"), (F.col("l_linestatus") == "O").alias("active"))
    return drafts.draft_report(new.select("script_pair").distinct(), new, old, aliases, attributes, facts)


@query("G33_changed_lines", with_("facts", then="""SELECT s.o_orderkey AS scene_id, count(DISTINCT e) AS entities FROM orders s JOIN (SELECT scene_id,
      unnest([x FOR x IN [subject_entity_id, object_entity_id] IF x IS NOT NULL]) AS e FROM facts WHERE active) f ON f.scene_id = s.o_orderkey
    WHERE s.o_orderstatus <> 'P' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = s.o_orderkey AND l_returnflag <> 'A') GROUP BY 1"""))
def g33(t):
    scenes = t.orders.select(
        F.col("o_orderkey").alias("scene_id"), F.col("o_custkey").alias("script_id"), F.lit(None).cast("long").alias("predecessor_scene_id"),
        F.expr("CASE o_orderstatus WHEN 'P' THEN 'unchanged' WHEN 'F' THEN 'modified' ELSE 'inserted' END").alias("lineage_kind"))
    lines = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_id"),
                              F.col("l_orderkey").alias("scene_id"), F.col("l_returnflag").alias("text"))
    before = F.concat(F.lit("before "), "unit_id")
    olds = lines.select(before.alias("unit_id"), (-F.col("scene_id")).alias("scene_id"), F.lit("A").alias("text"),
                        F.lit(None).cast("string").alias("predecessor_unit_id"))
    units = lines.withColumn("predecessor_unit_id", before).unionByName(olds)
    facts = t.facts.withColumn("unit_scene_id", F.col("scene_id"))
    none = t.spark.createDataFrame([], "script_id long, entity_id long, predecessor_entity_id long")
    _, affected = drafts.changed_lines(scenes, units, facts, none)
    return affected.groupBy("scene_id").agg(F.count_distinct("entity_id").alias("entities"))

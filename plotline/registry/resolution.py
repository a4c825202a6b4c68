"""Duplicates, merges, resolution, renames and seeding."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import names
from plotline.plans import duplicates, merge, seed
from plotline.registry import corpora, query
from plotline.registry.joins import SURFACES, surfaces
from plotline.sources import truth
from plotline.sources.tables import with_


@query("G10_duplicate_entities", "WITH " + SURFACES + """, al AS (SELECT entity_id, string_split(name, ' ')[1] || ' one' AS alias, script_id,
      entity_type FROM e WHERE contains(name, ' ')),
    n2 AS (SELECT * FROM e UNION ALL SELECT DISTINCT script_id, entity_type, 'red one', 5000000000 + script_no * 10 + ty FROM (SELECT *,
      CAST(string_split(script_id, '#')[2] AS BIGINT) AS script_no, length(entity_type) AS ty FROM e)),
    p AS (SELECT a.script_id, a.entity_type, least(a.entity_id, b.entity_id) AS x, greatest(a.entity_id, b.entity_id) AS y,
      'one name contains the other' AS reason FROM n2 a JOIN n2 b ON a.script_id = b.script_id AND a.entity_type = b.entity_type
      AND a.name <> b.name AND contains(' ' || b.name || ' ', ' ' || a.name || ' ')
      UNION ALL SELECT n.script_id, n.entity_type, least(n.entity_id, al.entity_id), greatest(n.entity_id, al.entity_id),
      'they share a name' FROM n2 n JOIN al ON n.script_id = al.script_id AND n.entity_type = al.entity_type AND n.name = al.alias
      AND n.entity_id <> al.entity_id),
    d AS (SELECT script_id, entity_type, x, y, min(reason) AS reason FROM p WHERE x % 7 <> 0 GROUP BY 1, 2, 3, 4),
    g AS (SELECT i, count(*) AS m FROM (SELECT x AS i FROM d UNION ALL SELECT y FROM d) GROUP BY 1),
    c AS (SELECT l_partkey AS i, count(*) AS k FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'A' GROUP BY 1)
    SELECT CASE WHEN yw THEN y ELSE x END AS keep_id, CASE WHEN yw THEN x ELSE y END AS absorb_id, reason, greatest(gx, gy) AS degree
    FROM (SELECT d.*, gx.m AS gx, gy.m AS gy, coalesce(cy.k, 0) > coalesce(cx.k, 0) OR (coalesce(cy.k, 0) = coalesce(cx.k, 0)
      AND length(ny.name) > length(nx.name)) AS yw FROM d JOIN g gx ON gx.i = x JOIN g gy ON gy.i = y JOIN n2 nx ON nx.entity_id = x
      JOIN n2 ny ON ny.entity_id = y LEFT JOIN c cx ON cx.i = x LEFT JOIN c cy ON cy.i = y)""")
def g10(t):
    base = surfaces(t)
    scope = base.select("script_id", "entity_type").distinct()
    extra = scope.select("script_id", "entity_type", F.lit("red one").alias("canonical_name"), (
        F.lit(5000000000) + F.element_at(F.split("script_id", "#"), 2).cast("long") * 10 + F.char_length("entity_type"))
        .alias("entity_id"), F.lit("red one").alias("normalized_name"))
    entities = base.unionByName(extra)
    aliases = base.filter(F.contains("canonical_name", F.lit(" "))).select("entity_id", F.concat(
        F.element_at(F.split("canonical_name", " "), 1), F.lit(" one")).alias("normalized_alias"))
    every = duplicates.containment_pairs(entities).unionByName(duplicates.alias_pairs(entities, aliases))
    apart = every.filter("a_id % 7 = 0").select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    cited = duplicates.cited_counts(t.facts.filter("predicate = 'requires'"))
    return duplicates.detect(entities, aliases, apart, cited).select("keep_id", "absorb_id", "reason", "degree")


@query("G11_merge_entities", with_("facts", then=""", m AS (SELECT p_partkey AS a, p_partkey - p_partkey % 10 AS k FROM part
      WHERE p_partkey % 10 <> 0), q AS (SELECT assertion_id, predicate, source_unit_id, subject_scene_id AS ss,
      coalesce(ms.k, subject_entity_id) AS se, coalesce(mo.k, object_entity_id) AS oe, active,
      ms.k IS NOT NULL OR mo.k IS NOT NULL AS moved FROM facts LEFT JOIN m ms ON ms.a = subject_entity_id
      LEFT JOIN m mo ON mo.a = object_entity_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY predicate, source_unit_id, ss, se, oe ORDER BY moved, assertion_id) AS n,
      bool_or(NOT moved) OVER (PARTITION BY predicate, source_unit_id, ss, se, oe) AS held FROM q)
    SELECT predicate, count(*) AS n, CAST(sum(oe) AS BIGINT) AS objects FROM r WHERE NOT moved OR (NOT held AND n = 1) GROUP BY 1""")
       .replace("\n, m AS", ", m AS"))
def g11(t):
    """Ten neighbouring parts become one: 1..9 are absorbed by 0, and 5 again by 4, which is skipped."""
    absorb = t.part.filter("p_partkey % 10 <> 0").select(
        F.col("p_partkey").alias("position"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("keep_id"),
        F.col("p_partkey").alias("absorb_id"))
    again = t.part.filter("p_partkey % 10 = 5").select(
        (F.col("p_partkey") + 1000000000).alias("position"), (F.col("p_partkey") - 1).alias("keep_id"),
        F.col("p_partkey").alias("absorb_id"))
    root = merge.roots(merge.in_force(absorb.unionByName(again)))
    entities = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"),
                             F.col("p_name").alias("normalized_name"))
    aliases = t.spark.createDataFrame([], "entity_id long, alias string, normalized_alias string")
    facts = t.facts.withColumn("script_id", F.lit(0))
    after = merge.merge({"assertions": facts, "entities": entities, "aliases": aliases}, root)
    return after["assertions"].groupBy("predicate").agg(F.count(F.lit(1)).alias("n"),
                                                        F.sum("object_entity_id").alias("objects"))


@query("G11_merge_aliases", """SELECT p_partkey - p_partkey % 10 AS entity_id, p_name AS alias FROM part a WHERE p_partkey % 10 <> 0 AND
    p_name <> (SELECT b.p_name FROM part b WHERE b.p_partkey = a.p_partkey - a.p_partkey % 10) GROUP BY 1, 2""")
def g11_aliases(t):
    root = t.part.filter("p_partkey % 10 <> 0").select(
        F.col("p_partkey").alias("entity_id"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("root_id"),
        F.col("p_partkey").alias("position"))
    entities = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"),
                             names.normalize_ascii(F.col("p_name")).alias("normalized_name"))
    aliases = t.spark.createDataFrame([], "entity_id long, alias string, normalized_alias string")
    facts = t.facts.withColumn("script_id", F.lit(0))
    return merge.merge({"assertions": facts, "entities": entities, "aliases": aliases}, root)["aliases"].select(
        "entity_id", "alias")


@query("G12_keep_separate", """SELECT DISTINCT least(l_partkey, l_suppkey) AS a_id, greatest(l_partkey, l_suppkey) AS b_id FROM lineitem
    WHERE l_partkey <> l_suppkey""")
def g12(t):
    return duplicates.separated(t.lineitem.select(F.col("l_partkey").alias("a_id"), F.col("l_suppkey").alias("b_id")))


RESOLVE = """e AS (SELECT p_brand AS sc, p_type AS ty, p_name AS nm, min(p_partkey) AS id FROM part WHERE p_size <= 12 GROUP BY 1, 2, 3),
    al AS (SELECT sc, ty, string_split(nm, ' ')[2] AS al, min(id) AS lo, max(id) AS hi FROM e GROUP BY 1, 2, 3),
    q AS (SELECT DISTINCT p_brand AS sc, p_type AS ty, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN string_split(p_name, ' ')[2]
      ELSE string_split(p_name, ' ')[1] END AS nm FROM part WHERE p_size > 12)"""


@query("G13_resolve_entities", "WITH " + RESOLVE + """ SELECT q.sc AS script_id, q.ty AS entity_type, q.nm AS normalized_name,
      coalesce(e.id, CASE WHEN al.lo = al.hi THEN al.lo END, x.id) AS entity_id,
      CASE WHEN e.id IS NOT NULL THEN 'name' WHEN al.lo = al.hi THEN 'alias' WHEN x.id IS NOT NULL THEN 'extension' ELSE 'new' END AS how
    FROM q LEFT JOIN e USING (sc, ty, nm) LEFT JOIN al ON al.sc = q.sc AND al.ty = q.ty AND al.al = q.nm
    LEFT JOIN (SELECT sc, string_split(nm, ' ')[1] AS f, min(id) AS id FROM e WHERE ty = 'LARGE' GROUP BY 1, 2 HAVING count(*) = 1) x
      ON x.sc = q.sc AND q.ty = 'LARGE' AND x.f = q.nm""")
def g13(t):
    kind = F.when(F.col("p_type") == "LARGE", "cast").otherwise(F.col("p_type"))
    entities = t.part.filter("p_size <= 12").groupBy(
        F.col("p_brand").alias("script_id"), kind.alias("entity_type"), F.col("p_name").alias("normalized_name")).agg(
        F.min("p_partkey").alias("entity_id"))
    aliases = entities.select("entity_id", F.element_at(F.split("normalized_name", " "), 2).alias("normalized_alias"))
    word = F.split("p_name", " ")
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, word[1]).otherwise(word[0])
    mentions = t.part.filter("p_size > 12").select(F.col("p_brand").alias("script_id"), kind.alias("entity_type"),
                                                  name.alias("normalized_name"))
    found = merge.resolve(mentions, entities, aliases)
    return found.withColumn("entity_type", F.when(F.col("entity_type") == "cast", "LARGE").otherwise(F.col("entity_type")))


@query("G13_resolve_in_order")
def g13_strict(t):
    entities = t.part.filter("p_size <= 12").groupBy(
        F.col("p_brand").alias("script_id"), F.lit("cast").alias("entity_type"), F.col("p_name").alias("normalized_name")
    ).agg(F.min("p_partkey").alias("entity_id"))
    aliases = entities.select("entity_id", F.element_at(F.split("normalized_name", " "), 2).alias("normalized_alias"))
    mentions = t.part.filter("p_size > 12").select(
        F.col("p_brand").alias("script_id"), F.lit("cast").alias("entity_type"),
        F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 2 == 0, F.lit("two"))).alias("normalized_name"),
        F.col("p_partkey").alias("position"), F.array(F.lower("p_type")).alias("aliases"))
    return merge.resolve_strictly(entities, aliases, mentions)


def rename_frames(t):
    """Each conversation as a draft of the one before it, its users renamed."""
    rows = t.conversations
    new_units = rows.select(
        F.col("conv_id").alias("script_id"), F.concat_ws("-", "conv_id", "turn").alias("unit_id"),
        F.concat_ws("-", F.col("conv_id") - 1, "turn").alias("predecessor_unit_id"),
        F.when(F.col("role") == "user", "patron").otherwise(F.col("role")).alias("speaker"))
    old_units = rows.select(F.concat_ws("-", "conv_id", "turn").alias("unit_id"), F.col("conv_id").alias("old_script_id"),
                            F.col("role").alias("speaker"))
    code = F.expr("CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END")
    old_cast = rows.select(F.col("conv_id").alias("old_script_id"), (F.col("conv_id") * 10 + code).alias("entity_id"),
                           F.upper("role").alias("canonical_name"), F.col("role").alias("normalized_name")).distinct()
    added = rows.filter("role = 'user'").select(
        F.col("conv_id").alias("script_id"), (F.col("conv_id") * 10 + 9).alias("entity_id"),
        F.lit("Patron Lee").alias("canonical_name"), F.lit("patron lee").alias("normalized_name")).distinct()
    none = t.spark.createDataFrame([], "entity_id long, normalized_alias string")
    return new_units, old_units, added, merge.names_of(added, none), old_cast, merge.names_of(old_cast, none)


RENAMES = """c AS (SELECT n.conv_id AS sc, CASE n.role WHEN 'user' THEN 'patron' ELSE n.role END AS now, o.role AS was, count(*) AS n
      FROM conversations n JOIN conversations o ON o.conv_id = n.conv_id - 1 AND o.turn = n.turn GROUP BY 1, 2, 3),
    m AS (SELECT sc, was, sum(n) AS total FROM c GROUP BY 1, 2),
    b AS (SELECT sc, max_by(was, (n, CASE was WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END)) AS was, max(n) AS n FROM c
      WHERE now = 'patron' GROUP BY 1)"""


@query("G30_draft_renames", "WITH " + RENAMES + """ SELECT sc AS script_id, upper(was) AS old_name, CAST(n AS BIGINT) AS transferred,
    CAST(total AS BIGINT) AS total_mapped, n >= 3 AND n / total >= 0.8 AS automatic FROM b JOIN m USING (sc, was) WHERE n / total >= 0.5""")
def g30(t):
    return merge.detect_renames(*rename_frames(t)).select("script_id", "old_name", "transferred", "total_mapped", "automatic")


@query("G31_rename_leftovers", """SELECT conv_id AS script_id, count(*) AS lines FROM conversations WHERE role = 'user' GROUP BY 1""")
def g31(t):
    survivors = t.conversations.select(F.col("conv_id").alias("script_id"), F.col("conv_id").alias("entity_id"),
                                       F.lit("patron lee").alias("normalized_name")).distinct()
    aliases = survivors.select("entity_id", F.explode(F.array(F.lit("user one"), F.lit("patron"))).alias("normalized_alias"))
    cues = t.conversations.select(F.col("conv_id").alias("script_id"), F.concat_ws("-", "conv_id", "turn").alias("unit_id"),
                                  F.when(F.col("role") == "system", "patron").otherwise(F.col("role")).alias("speaker"))
    return merge.leftovers(survivors, aliases, cues).groupBy("script_id").agg(F.count(F.lit(1)).alias("lines"))


@query("G31_rename_twins", "WITH " + RENAMES + """ SELECT sc * 10 + 9 AS entity_id, CASE WHEN was = 'user' THEN sc * 10 END AS root_id FROM b
    JOIN m USING (sc, was) WHERE n / total >= 0.5""")
def g31_twins(t):
    found = merge.detect_renames(*rename_frames(t))
    entities = found.filter("old_entity_id % 10 = 1").select(
        "script_id", (F.col("script_id") * 10).alias("entity_id"), F.col("old_entity_id").alias("predecessor_entity_id"))
    absorbed, linked = merge.rename_roots(found, entities)
    return absorbed.select("entity_id", "root_id").unionByName(
        linked.select("entity_id", F.lit(None).cast("long").alias("root_id")))


@query("G41_seed_graph", """SELECT p_partkey AS doc_id, predicate, scene, at_start AS start_at FROM (
      SELECT *, unnest(['establishes', 'requires', 'requires', 'requires']) AS predicate, unnest([p_size || 'A', p_size || 'A', '5', p_size
        || '']) AS scene, unnest([4, 4, NULL, NULL]) AS at_start FROM part)
    WHERE NOT (scene = '5' AND p_size = 5 AND at_start IS NULL AND false) GROUP BY ALL""")
def g41(t):
    frames = truth.routed(truth.tables(corpora.truth_texts(t)))
    number = F.explode(F.array_distinct(F.array(F.concat("p_size", F.lit("A")), F.lit("5"), F.col("p_size").cast("string"))))
    scenes = t.part.select(F.col("p_partkey").alias("doc_id"), number.alias("number"), "p_name").withColumns({
        "scene_id": F.concat_ws("/", "doc_id", "number"), "heading": F.lit("INT. HALL")})
    text = F.when(F.col("number").endswith("A"), F.concat(F.lit("See "), "p_name", F.lit("."))).otherwise("Nothing.")
    units = scenes.select("scene_id", F.concat("scene_id", F.lit(":0")).alias("unit_id"), F.lit(0).alias("sequence_index"),
                          text.alias("text"), F.lit(None).cast("string").alias("speaker"))
    _, edges, _ = seed.seed(frames, scenes.drop("p_name"), units)
    return edges.select(F.col("script_id").alias("doc_id"), "predicate", F.element_at(F.split("subject_scene_id", "/"), 2)
                        .alias("scene"), F.col("start").cast("long").alias("start_at"))

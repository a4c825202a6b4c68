"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import names, words
from plotline.operators import filters as P
from plotline.operators import joins as J
from plotline.operators import ledger, mentions
from plotline.registry import query
from plotline.sources.tables import with_


@query("J1_inner_join", with_("scripts", then="""SELECT title, count(*) AS n FROM scripts JOIN orders
    ON o_custkey = script_id GROUP BY title"""))
def j1(t):
    scenes = t.scenes.groupBy("script_id").agg(F.count(F.lit(1)).alias("n"))
    return scenes.join(t.scripts, "script_id").select("title", "n")


@query("J2_left_join", with_("scripts", "calls", then="""SELECT call_id, coalesce(title, '') AS title
    FROM calls c LEFT JOIN (SELECT * FROM scripts WHERE graph_status = 'ready') s
    ON c.script_id = s.script_id"""))
def j2(t):
    ready = t.scripts.filter("graph_status = 'ready'").select("script_id", "title")
    return t.model_calls.join(ready, "script_id", "left").select(
        "call_id", F.coalesce("title", F.lit("")).alias("title"))


FINDINGS = """findings AS (SELECT o_orderkey AS finding_id, o_custkey AS script_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'low' END
    AS severity, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'dismissed' ELSE 'open' END
    AS status FROM orders)"""


@query("J3_earliest_place", "WITH " + FINDINGS + """, places AS (SELECT finding_id, severity,
      min(l_partkey * 10 + l_linenumber) AS place FROM findings
      LEFT JOIN lineitem ON l_orderkey = finding_id AND l_returnflag = 'R' GROUP BY 1, 2)
    SELECT finding_id, place // 10 AS scene_index, place % 10 AS unit_index,
      row_number() OVER (PARTITION BY severity ORDER BY place NULLS LAST, finding_id) AS position
    FROM places""")
def j3(t):
    evidence = t.lineitem.filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("finding_id"), F.col("l_partkey").alias("scene_index"),
        F.col("l_linenumber").cast("long").alias("unit_index"))
    placed = J.earliest_place(J.findings(t).select("finding_id", "severity"), evidence)
    return J.ranked_places(placed, ["severity"]).select(
        "finding_id", "scene_index", "unit_index", "position")


@query("J4_semi_join", with_("scripts", "facts", "assertions", then="""SELECT script_id, title FROM scripts
    WHERE script_id IN (SELECT script_id FROM assertions WHERE active AND predicate = 'establishes'
    AND confidence < 0.6)"""))
def j4(t):
    cited = P.active(t.assertions).filter("predicate = 'establishes' AND confidence < 0.6")
    return t.scripts.join(cited.select("script_id"), "script_id", "left_semi").select(
        "script_id", "title")


@query("J5_pending_scenes", with_("scenes", then="""SELECT script_id, count(*) AS pending FROM scenes
    WHERE NOT omitted AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = scene_id
      AND l_linestatus = 'O' AND l_returnflag = 'A') GROUP BY script_id"""))
def j5(t):
    from plotline.plans.build import pending_scenes
    scenes = t.scenes.withColumn("input_hash", F.sha2(F.concat("heading", "scene_id"), 256))
    cache = t.lineitem.filter("l_linestatus = 'O'").select(
        F.col("l_orderkey").alias("scene_id"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'completed' ELSE 'failed' END").alias("status"))
    cache = cache.join(scenes.select("scene_id", "input_hash"), "scene_id").withColumns(
        {"prompt_version": F.lit("v1"), "model_id": F.lit("m")})
    return pending_scenes(scenes, cache, "v1", "m").groupBy("script_id").agg(
        F.count(F.lit(1)).alias("pending"))


SURFACES = """e AS (SELECT p_brand AS script_id, p_type AS entity_type, p_name AS name,
      min(p_partkey) AS entity_id FROM part GROUP BY 1, 2, 3
      UNION ALL SELECT p_brand, p_type, string_split(p_name, ' ')[-1], min(p_partkey) + 1000000000
      FROM part GROUP BY 1, 2, 3)"""
PAIRS_SQL = "WITH " + SURFACES + """,
    p AS (SELECT a.script_id, a.entity_type, least(a.entity_id, b.entity_id) AS a_id,
      greatest(a.entity_id, b.entity_id) AS b_id FROM e a JOIN e b
      ON a.script_id = b.script_id AND a.entity_type = b.entity_type AND a.name <> b.name
      AND contains(' ' || b.name || ' ', ' ' || a.name || ' '))
    SELECT DISTINCT script_id, entity_type, a_id, b_id FROM p"""


def surfaces(t):
    """Entities by full name, and a second entity for each bare noun."""
    noun = F.element_at(F.split("p_name", " "), -1)
    full = t.part.groupBy(F.col("p_brand").alias("script_id"), F.col("p_type").alias("entity_type"),
                          F.col("p_name").alias("canonical_name")).agg(
        F.min("p_partkey").alias("entity_id"))
    bare = t.part.groupBy(F.col("p_brand").alias("script_id"), F.col("p_type").alias("entity_type"),
                          noun.alias("canonical_name")).agg(
        (F.min("p_partkey") + 1000000000).alias("entity_id"))
    return full.unionByName(bare).withColumn(
        "normalized_name", names.normalize_ascii(F.col("canonical_name")))


@query("J6_phrase_containment", PAIRS_SQL)
def j6(t):
    from plotline.plans.duplicates import containment_pairs
    return containment_pairs(surfaces(t)).select("script_id", "entity_type", "a_id", "b_id")


@query("J7_interval_join", with_("calls", then="""SELECT c.call_id, min_by(q.event_id, (q.ts, q.event_id))
      AS question FROM calls c JOIN events q ON q.event_type = 'view'
      AND CASE WHEN q.user_id % 3 = 0 THEN 'small' WHEN q.user_id % 3 = 1 THEN 'large'
        ELSE 'unpriced' END = c.model_id
      AND q.ts >= c.created_at AND q.ts <= c.created_at + INTERVAL 120 SECONDS
    WHERE c.purpose = 'query' GROUP BY c.call_id"""))
def j7(t):
    asked = t.model_calls.filter("purpose = 'extract'").select(
        "model_id", F.col("created_at").alias("asked_at"), F.col("call_id").alias("question"))
    return ledger.answered_by(t.model_calls.filter("purpose = 'query'"), asked, "model_id")


@query("J8_range_containment", with_("calls", then="""SELECT script_id, d AS day FROM (SELECT script_id,
      date_trunc('day', created_at) AS day, strftime(created_at, '%Y-%m-%d') AS d,
      min(created_at) AS first, max(created_at) AS last FROM calls WHERE purpose = 'extract'
      GROUP BY 1, 2, 3) s WHERE EXISTS (SELECT 1 FROM calls c WHERE c.script_id = s.script_id
      AND c.purpose = 'agent' AND c.created_at BETWEEN first AND last)"""))
def j8(t):
    calls = t.model_calls
    spans = calls.filter("purpose = 'extract'").groupBy(
        "script_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    runs = calls.filter("purpose = 'agent'").select("script_id",
                                                   F.col("created_at").alias("started_at"))
    spans = spans.withColumn("span_id", F.concat_ws("|", "script_id", "day"))
    return ledger.holding(spans, runs, "script_id", "span_id").select("script_id", "day")


@query("J9_endpoint_join", with_("facts", "entities", then="""SELECT entity_id, count(DISTINCT assertion_id)
    AS n FROM entities JOIN facts ON active AND (subject_entity_id = entity_id
      OR object_entity_id = entity_id) GROUP BY entity_id"""))
def j9(t):
    ends = J.endpoint_frame(P.active(t.facts))
    return ends.join(t.entities.select("entity_id"), "entity_id").groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("J10_full_outer", """WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem
      WHERE l_linestatus = 'F'), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem
      WHERE l_linestatus = 'O')
    SELECT CASE WHEN a.l_orderkey IS NULL THEN 'added' WHEN b.l_orderkey IS NULL THEN 'removed'
      ELSE 'unchanged' END AS state, count(*) AS n FROM a FULL JOIN b
      ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey GROUP BY 1""")
def j10(t):
    key = ["l_orderkey", "l_partkey"]
    a = t.lineitem.filter("l_linestatus = 'F'").select(*key).distinct()
    b = t.lineitem.filter("l_linestatus = 'O'").select(*key).distinct()
    return J.by_identity(a, b, key).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


FOLD = "replace(lower(strip_accents({0})), 'ß', 'ss')"
WORDS_SQL = ("list_filter(regexp_split_to_array(" + FOLD + ", '[^0-9a-z]+'), lambda w: w <> '')")


def benchmark_names(t):
    """Names to look for: the words of each benchmark passage, all of them."""
    spoken = words.tokens(names.fold(F.col("text")))
    return t.benchmark.select(F.col("item_id").alias("name_id"), spoken.alias("name_words"))


@query("J11_named_in_question", f"""WITH n AS (SELECT item_id, {WORDS_SQL.format('text')} AS w
      FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string({WORDS_SQL.format('text')}, ' ')
      || ' ' AS h FROM documents)
    SELECT doc_id, item_id FROM d JOIN n ON len(w) > 0 AND
      contains(h, ' ' || array_to_string(w, ' ') || ' ')""")
def j11(t):
    texts = t.texts.select(F.col("doc_id").alias("text_id"),
                               words.tokens(names.fold(F.col("text"))).alias("words"))
    named = J.not_only_stopwords(benchmark_names(t))
    return mentions.phrase_hits(texts, named).select(
        F.col("text_id").alias("doc_id"), F.col("name_id").alias("item_id"))


SIGNIFICANT_SQL = (r"list_distinct(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{Nl}}\p{{No}}]{{4,}}'),"
                   " lambda w: lower(w)))")


@query("J12_all_words_join", f"""WITH n AS (SELECT item_id, {SIGNIFICANT_SQL.format('text')} AS w
      FROM benchmark), d AS (SELECT doc_id, {SIGNIFICANT_SQL.format('text')} AS h FROM documents)
    SELECT doc_id, item_id FROM d JOIN n ON len(w) > 0 AND list_has_all(h, w)""")
def j12(t):
    texts = t.texts.select(F.col("doc_id").alias("text_id"),
                               words.significant(F.col("text")).alias("words"))
    named = t.benchmark.select(F.col("item_id").alias("name_id"), words.significant(
        F.col("text")).alias("name_words"))
    return mentions.all_words_hits(texts, named).select(
        F.col("text_id").alias("doc_id"), F.col("name_id").alias("item_id"))


@query("J13_label_lookup", with_("facts", then="""SELECT assertion_id, coalesce(s.p_name, 'Sc ' ||
      subject_scene_id) AS subject, predicate, o.p_name AS object FROM facts
      LEFT JOIN part s ON s.p_partkey = subject_entity_id
      LEFT JOIN part o ON o.p_partkey = object_entity_id"""))
def j13(t):
    labels = t.part.select(F.lit("entity").alias("kind"), F.col("p_partkey").alias("node_id"),
                           F.col("p_name").alias("label")).unionByName(
        t.scenes.select(F.lit("scene").alias("kind"), F.col("scene_id").alias("node_id"),
                        F.concat(F.lit("Sc "), "scene_id").alias("label")))
    return J.labelled(t.facts, labels).select(
        "assertion_id", F.col("subject_label").alias("subject"), "predicate",
        F.col("object_label").alias("object"))


# Each brand is a draft of the brand numbered one higher.
@query("J14_lineage_join", """WITH e AS (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS b, p_type, p_name, min(p_partkey) AS id FROM part
      GROUP BY 1, 2, 3)
    SELECT n.id AS entity_id, coalesce(x.id, a.id) AS source_id,
      CASE WHEN x.id IS NOT NULL THEN 'name' WHEN a.id IS NOT NULL THEN 'alias' ELSE 'added' END AS how
    FROM e n LEFT JOIN e x ON x.b = n.b + 1 AND n.p_type = x.p_type AND n.p_name = x.p_name
    LEFT JOIN (SELECT b, p_type, 'old ' || string_split(p_name, ' ')[-1] AS al, min(id) AS id FROM e GROUP BY 1, 2, 3) a
      ON a.b = n.b + 1 AND n.p_type = a.p_type AND 'old ' || string_split(n.p_name, ' ')[-1] = a.al""")
def j14(t):
    e = t.part.groupBy(F.expr("CAST(substr(p_brand, 7) AS INT)").alias("script_pair"), F.col("p_type").alias("entity_type"),
                       F.col("p_name").alias("normalized_name")).agg(F.min("p_partkey").alias("entity_id"))
    noun = F.concat(F.lit("old "), F.element_at(F.split("normalized_name", " "), -1))
    old = e.withColumn("script_pair", F.col("script_pair") - 1)
    new = e.withColumn("predecessor_entity_id", F.lit(None).cast("long"))
    aliases = old.withColumn("normalized_alias", noun)
    return J.lineage(new.withColumn("alias_key", noun), old, aliases).select(
        "entity_id", "source_id", "how")


@query("J15_positional_zip", """WITH p AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id
      ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT a.conv_id, a.turn, b.turn AS other_turn FROM p a JOIN p b ON b.conv_id = a.conv_id + 1
      AND a.k = b.k AND a.n = b.n""")
def j15(t):
    units = t.conversations.select(F.col("conv_id").alias("scene_id"),
                                   F.col("turn").alias("sequence_index"), F.col("turn").alias("unit_id"))
    pairs = units.select(F.col("scene_id").alias("old_scene_id"),
                         (F.col("scene_id") + 1).alias("new_scene_id")).distinct()
    zipped, _ = J.zip_units(pairs, units)
    return zipped.select(F.col("old_scene_id").alias("conv_id"), F.col("old_unit_id").alias("turn"),
                         F.col("new_unit_id").alias("other_turn"))


@query("J16_asof_offset", """SELECT e.event_id, (SELECT max_by(h.event_id, (h.ts, h.event_id)) FROM events h
      WHERE h.event_type = 'signup' AND h.user_id = e.user_id AND h.ts <= e.ts) AS heading
    FROM events e WHERE e.event_type = 'click'""")
def j16(t):
    marks = t.events.filter("event_type = 'signup'").select(
        "user_id", F.col("ts").alias("at"), F.col("event_id").alias("mark_id"))
    rows = t.events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("at"),
                                                         "event_id")
    return J.last_before(rows, marks, ["user_id"], "at", "event_id", "mark_id").select("event_id", F.col("mark_id").alias("heading"))


@query("J17_longest_name", """WITH l AS (SELECT DISTINCT p_brand AS script_id, p_name AS name FROM part
      UNION SELECT DISTINCT p_brand, substr(p_name, 2, 5) FROM part),
    h AS (SELECT p_partkey, p_brand, 'int. ' || p_name || ' - ' || lower(p_type) AS heading FROM part)
    SELECT p_partkey, max_by(name, (length(name), name)) AS location FROM h JOIN l
      ON l.script_id = h.p_brand AND contains(heading, name) GROUP BY 1""")
def j17(t):
    places = t.part.select(F.col("p_brand").alias("script_id"), F.col("p_name").alias("name")
                           ).unionByName(t.part.select(F.col("p_brand").alias("script_id"),
                                                       F.substring("p_name", 2, 5).alias("name"))
                                         ).distinct().withColumn("name_id", F.col("name"))
    heads = t.part.select(F.col("p_brand").alias("script_id"), F.col("p_partkey").alias("text_id"),
                          F.concat(F.lit("int. "), "p_name", F.lit(" - "), F.lower("p_type"))
                          .alias("text"))
    return J.longest_name(heads, places).select(F.col("text_id").alias("p_partkey"),
                                                F.col("name").alias("location"))


@query("J18_first_mention", """WITH w AS (SELECT conv_id, unnest(['queue', 'the', 'ation', 'el']) AS needle
      FROM (SELECT DISTINCT conv_id FROM conversations)),
    m AS (SELECT w.conv_id, turn, needle, instr(lower(text), needle) - 1 AS at FROM w
      JOIN conversations c ON c.conv_id = w.conv_id AND contains(lower(text), needle)),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, -length(needle), needle) AS k
      FROM m)
    SELECT s.conv_id, coalesce(r.turn, s.t) AS turn, r.at AS start_at, r.at + length(needle) AS end_at
    FROM (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY 1) s
    LEFT JOIN r ON r.conv_id = s.conv_id AND k = 1""")
def j18(t):
    units = t.conversations.select(F.col("conv_id").alias("scene_id"), "text",
                                   F.col("turn").alias("sequence_index"), F.col("turn").alias("unit_id"))
    wanted = units.select("scene_id").distinct().withColumn("entity_id", F.lit(1)).withColumn(
        "needle", F.explode(F.array(*[F.lit(x) for x in ("queue", "the", "ation", "el")])))
    return J.first_mention(wanted, units).select(
        F.col("scene_id").alias("conv_id"), F.col("unit_id").alias("turn"),
        F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("J19_plan_coverage", """WITH c AS (SELECT o_custkey, o_orderkey % 50 AS scene, min(o_orderpriority)
      AS citation FROM orders GROUP BY 1, 2),
    p AS (SELECT o_custkey, o_orderkey % 50 AS scene, min(o_orderstatus) AS change FROM orders
      WHERE o_totalprice > 250000 GROUP BY 1, 2)
    SELECT o_custkey, scene, coalesce(change, 'No change planned.') AS change, change IS NOT NULL AS needs,
      citation FROM c LEFT JOIN p USING (o_custkey, scene)""")
def j19(t):
    scene = (F.col("o_orderkey") % 50).alias("scene")
    covered = t.orders.groupBy("o_custkey", scene).agg(F.min("o_orderpriority").alias("citation"))
    planned = t.orders.filter("o_totalprice > 250000").groupBy("o_custkey", scene).agg(
        F.min("o_orderstatus").alias("change"))
    return J.cover_plan(planned, covered, ["o_custkey", "scene"]).select(
        "o_custkey", "scene", "change", "needs", "citation")


@query("J20_key_lookup", with_("scripts", "scenes", then="""SELECT title, graph_status, count(*) AS n
    FROM scenes JOIN scripts USING (script_id) WHERE NOT omitted GROUP BY 1, 2"""))
def j20(t):
    counts = t.scenes.filter(~F.col("omitted")).groupBy("script_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(t.scripts, "script_id").select("title", "graph_status", "n")


@query("J21_exclusion_join", with_("facts", then="""SELECT count(*) AS n FROM facts WHERE active
    AND (subject_entity_id IS NULL OR subject_entity_id NOT IN (SELECT s_suppkey FROM supplier
      WHERE s_acctbal < 0))"""))
def j21(t):
    barred = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("subject_entity_id"))
    return J.excluding(P.active(t.facts), barred, "subject_entity_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("U1_union_distinct", with_("facts", then="""SELECT count(*) AS n FROM (
    SELECT assertion_id, subject_entity_id AS e FROM facts WHERE subject_entity_id IS NOT NULL
    UNION SELECT assertion_id, object_entity_id FROM facts WHERE object_entity_id IS NOT NULL)"""))
def u1(t):
    return J.endpoint_frame(t.facts).agg(F.count(F.lit(1)).alias("n"))


@query("U2_union_all", """SELECT side, count(*) AS n, count(DISTINCT name) AS names FROM (
    SELECT 'name' AS side, p_name AS name FROM part UNION ALL SELECT 'alias', string_split(p_name, ' ')[-1]
    FROM part) GROUP BY side""")
def u2(t):
    aliases = t.part.select(F.col("p_partkey").alias("entity_id"),
                            F.element_at(F.split("p_name", " "), -1).alias("alias"))
    entities = t.part.select(F.col("p_partkey").alias("entity_id"),
                             F.col("p_name").alias("canonical_name"))
    return J.all_surfaces(entities, aliases).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


@query("U3_intersect", """SELECT count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM (
    SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'
    INTERSECT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'O')""")
def u3(t):
    key = ["l_orderkey", "l_partkey"]
    a = t.lineitem.filter("l_linestatus = 'F'").select(*key)
    b = t.lineitem.filter("l_linestatus = 'O'").select(*key)
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


@query("U4_except", """SELECT side, count(*) AS n FROM (SELECT 'removed' AS side, * FROM (
      SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'
      EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'O')
    UNION ALL SELECT 'added' AS side, * FROM (SELECT l_orderkey, l_partkey FROM lineitem
      WHERE l_linestatus = 'O' EXCEPT SELECT l_orderkey, l_partkey FROM lineitem
      WHERE l_linestatus = 'F')) GROUP BY side""")
def u4(t):
    key = ["l_orderkey", "l_partkey"]
    a = t.lineitem.filter("l_linestatus = 'F'").select(*key).distinct()
    b = t.lineitem.filter("l_linestatus = 'O'").select(*key).distinct()
    return J.by_identity(a, b, key).filter("state <> 'unchanged'").groupBy(
        F.col("state").alias("side")).agg(F.count(F.lit(1)).alias("n"))


ANSWER = "'The ' || p_name || ' near a SMALL RING; not red, widget. Hot gear-like'"


@query("U5_ungrounded_names", rf"""WITH n AS (SELECT DISTINCT p_name AS name FROM part),
    a AS (SELECT p_partkey, p_name AS g, lower({ANSWER}) AS text FROM part)
    SELECT p_partkey, name FROM a JOIN n ON length(name) >= 3 AND NOT contains(g, name)
      AND NOT contains(name, g) AND regexp_matches(text, '\b' || name || '\b')""")
def u5(t):
    answers = t.part.select(F.col("p_partkey").alias("answer_id"), F.expr(ANSWER).alias("answer"))
    grounded = t.part.select(F.col("p_partkey").alias("answer_id"), F.col("p_name").alias("name"))
    return mentions.ungrounded_names(answers, grounded, t.part.select(F.col("p_name").alias("name"))
                                     ).select(F.col("answer_id").alias("p_partkey"), "name")

"""Projections, filters and data-quality predicates over the graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions import words
from plotline.operators import filters as P
from plotline.operators import quality
from plotline.registry import query
from plotline.registry.functions import CAPS, PHRASES_SQL, derived
from plotline.sources.tables import with_


@query("P1_active_rows", with_("facts", "assertions", then="""SELECT script_id, predicate,
    count(*) AS n FROM assertions WHERE active GROUP BY 1, 2"""))
def p1(t):
    return P.active(t.assertions).groupBy("script_id", "predicate").agg(
        F.count(F.lit(1)).alias("n"))


@query("P2_confidence_threshold", with_("facts", "assertions", then="""SELECT script_id,
    count(*) FILTER (confidence >= 0.7) AS shown, count(*) FILTER (confidence < 0.7) AS hidden
    FROM assertions WHERE active GROUP BY 1"""))
def p2(t):
    return P.threshold_counts(P.active(t.assertions), ["script_id"], 0.7)


@query("P3_department_filter", with_("facts", then="""SELECT count(*) AS n, sum(object_entity_id) AS s
    FROM (SELECT f.*, a.p_type AS st, b.p_type AS ot FROM facts f
      LEFT JOIN part a ON a.p_partkey = subject_entity_id
      LEFT JOIN part b ON b.p_partkey = object_entity_id)
    WHERE st IN ('STANDARD', 'PROMO') OR ot IN ('STANDARD', 'PROMO')""")
       .replace("sum(object_entity_id)", "CAST(sum(object_entity_id) AS BIGINT)"))
def p3(t):
    types = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"))
    kept = P.in_departments(t.facts, types, ["STANDARD", "PROMO"])
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("object_entity_id").alias("s"))


@query("P4_node_labels", with_("scenes", then="""SELECT scene_id, CASE
      WHEN number IS NOT NULL THEN 'Sc ' || number
      WHEN max(number) OVER (PARTITION BY script_id) IS NOT NULL THEN 'Sc —'
      ELSE 'Sc ' || (sequence_index + 1) END AS label FROM scenes"""))
def p4(t):
    return P.scene_labels(t.ordered_scenes).select("scene_id", "label")


@query("P5_endpoints", with_("facts", then="""SELECT assertion_id,
    coalesce(subject_entity_id, subject_scene_id) AS subject_key,
    coalesce(object_entity_id, object_scene_id) AS object_key FROM facts"""))
def p5(t):
    return t.facts.select("assertion_id", P.endpoint("subject").alias("subject_key"),
                          P.endpoint("object").alias("object_key"))


@query("P6_assertion_scene", with_("facts", then="""SELECT assertion_id,
    coalesce(subject_scene_id, object_scene_id, scene_id) AS in_scene FROM facts"""))
def p6(t):
    units = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit_id"),
                              F.col("l_orderkey").alias("scene_id")).distinct()
    return P.with_scene(t.facts.drop("scene_id"), units).select("assertion_id", "in_scene")


@query("P7_library_filters", with_("scripts", then="""SELECT 'all' AS filter, count(*) AS n FROM scripts
    UNION ALL SELECT 'needs_review', count(*) FROM scripts WHERE import_status = 'needs_review'
    UNION ALL SELECT 'recent', count(*) FROM scripts WHERE opened_at IS NOT NULL"""))
def p7(t):
    def count(name):
        return P.library(t.scripts, name).agg(F.lit(name).alias("filter"),
                                              F.count(F.lit(1)).alias("n"))
    return count("all").unionByName(count("needs_review")).unionByName(count("recent"))


@query("P8_cell_search", """SELECT doc_id FROM documents WHERE contains(
    lower(concat_ws(' ', lang, source, text)), 'thing')""")
def p8(t):
    return P.search(t.documents, ["lang", "source", "text"], "THING").select("doc_id")


@query("P9_vocabulary_rules", with_("facts", then="""SELECT rule, count(*) AS n FROM (
      SELECT 'confidence_range' AS rule FROM facts WHERE confidence > 0.9
      UNION ALL SELECT 'predicate_vocabulary' FROM facts WHERE predicate NOT IN ('uses', 'establishes')
      UNION ALL SELECT 'subject_side' FROM facts WHERE predicate = 'uses' AND scene_id % 2 = 0)
    GROUP BY rule"""))
def p9(t):
    """The standing rules, run on rows damaged in three ways."""
    damaged = t.facts.withColumns({
        "manner": F.lit(None).cast("string"), "provenance": F.lit("system"),
        "evidence_start": F.lit(None).cast("int"),
        "confidence": F.expr("CASE WHEN confidence > 0.9 THEN confidence + 1 ELSE confidence END"),
        "predicate": F.expr("CASE predicate WHEN 'requires' THEN 'needs' ELSE predicate END"),
        "subject_scene_id": F.expr("CASE WHEN predicate = 'uses' AND scene_id % 2 = 0 "
                                   "THEN scene_id ELSE subject_scene_id END")})
    found = quality.violations(damaged, quality.ASSERTION_RULES)
    return found.select(F.explode("violations").alias("rule")).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"))


@query("P10_uniqueness", with_("facts", then="""SELECT source_unit_id, predicate, count(*) AS n FROM facts
    WHERE active GROUP BY 1, 2 HAVING count(*) > 1"""))
def p10(t):
    return quality.duplicates(P.active(t.facts), ["source_unit_id", "predicate"])


@query("P11_signatures", """WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE l_returnflag WHEN 'A' THEN 'requires' WHEN 'N' THEN 'wears' ELSE 'unknown' END AS p,
      CASE WHEN l_linestatus = 'O' THEN 'scene' ELSE 'entity' END AS sk, p_type FROM lineitem
      JOIN part ON p_partkey = l_partkey)
    SELECT reason, count(*) AS n FROM (SELECT CASE
      WHEN p = 'unknown' THEN 'unknown_predicate'
      WHEN p = 'requires' AND sk <> 'scene' THEN 'subject_kind'
      WHEN p = 'wears' AND sk <> 'entity' THEN 'subject_kind'
      WHEN p = 'requires' AND p_type = 'LARGE' THEN 'object_type'
      WHEN p = 'wears' AND p_type <> 'ECONOMY' THEN 'object_type' ELSE 'ok' END AS reason FROM k)
    GROUP BY reason""")
def p11(t):
    from plotline.sources.tables import ENTITY_TYPE
    edges = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.expr("CASE l_returnflag WHEN 'A' THEN 'requires' WHEN 'N' THEN 'wears' ELSE 'unknown' END")
        .alias("predicate"),
        F.when(F.col("l_linestatus") == "O", "scene").otherwise("entity").alias("subject_kind"),
        F.lit("entity").alias("object_kind"),
        F.when(F.col("l_linestatus") == "F", "cast").alias("subject_type"),
        F.expr(ENTITY_TYPE).alias("object_type"))
    reason = F.coalesce(quality.signature_reason(), F.lit("ok"))
    return edges.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


PLACE = (f"CASE n % 9 WHEN 0 THEN 'everybody' WHEN 1 THEN 'Two men from ' || {CAPS} "
         f"WHEN 2 THEN 'Lords, Ladies, and ' || {CAPS} WHEN 3 THEN 'UPDATED. ' || {CAPS} "
         f"WHEN 4 THEN 'TIME: The sixth of March, 1886' WHEN 5 THEN 'Enter ' || {CAPS} "
         f"WHEN 6 THEN 'A room which is ' || {CAPS} WHEN 7 THEN 'the table has ' || {CAPS} "
         f"ELSE phrase END")


def _q(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


GROUP_RE = quality.GROUP_LABEL
LIST_RE = quality.ROLE_LIST
SENTENCE_RE = r"[\p{L}\p{N}_]{4,}[.!?]\s+[A-Z]"
TIME_SQL = (r"list_filter(regexp_extract_all(lower(regexp_replace(trim(x), '^[A-Z][A-Z ]*:\s*', '')), "
            r"'[a-z'']+|\d+'), lambda w: w NOT IN (" + _q(vocab.TIME_STOPWORDS) + "))")
PLACE_SQL = (r"regexp_extract_all(lower(x), '[a-z'']+')")


@query("P12_unusable_names", rf"""WITH k AS (SELECT doc_id, pos, {PLACE} AS x FROM {PHRASES_SQL}),
    j AS (SELECT *, lower(trim(x)) AS f, {TIME_SQL} AS tw, {PLACE_SQL} AS pw FROM k)
    SELECT doc_id, pos, CASE WHEN f IN ({_q(vocab.NON_ENTITY_NAMES)}) THEN 'pronoun_or_group_name'
        WHEN regexp_matches(trim(x), '{GROUP_RE}') OR regexp_matches(x, '{LIST_RE}')
          THEN 'pronoun_or_group_name'
        WHEN regexp_matches(x, '{SENTENCE_RE}') THEN 'sentence_like_name' END AS as_cast,
      CASE WHEN f IN ({_q(vocab.NON_ENTITY_NAMES)}) THEN 'pronoun_or_group_name'
        WHEN length(trim(x)) > 48 OR len(list_filter(range(1, len(pw) + 1), lambda i:
          pw[i] IN ({_q(vocab.PLACE_PREDICATES)}) AND (i = 1 OR
          pw[i - 1] NOT IN ({_q(vocab.RELATIVE_PRONOUNS)})))) > 0 THEN 'descriptive_location'
        WHEN f IN ({_q(vocab.PRODUCTION_MARKERS)})
          OR regexp_matches(trim(x), '(?i)^(?:re-)?(?:enter|exeunt|exit)\b') THEN 'not_a_place'
        WHEN len(tw) > 0 AND len(list_filter(tw, lambda w: NOT (w IN ({_q(vocab.TIME_WORDS)})
          OR regexp_matches(w, '^\d+$')))) = 0 THEN 'names_a_time'
        WHEN regexp_extract(lower(trim(x)), '^[a-z]+') IN ({_q(vocab.CIRCUMSTANCE_OPENERS)})
          THEN 'names_a_circumstance' END AS as_location FROM j""")
def p12(t):
    raw = F.col("raw")
    return derived(t, PLACE, "raw").select(
        "doc_id", "pos", quality.unusable_name(raw, F.lit("cast")).alias("as_cast"),
        quality.unusable_name(raw, F.lit("location")).alias("as_location"))


@query("P13_confidence_floor", with_("facts", then="""SELECT CASE WHEN predicate = 'establishes'
      AND confidence < 0.8 THEN 'held' ELSE 'kept' END AS part, count(*) AS n FROM facts GROUP BY 1"""))
def p13(t):
    operations = t.facts.withColumn("operation_type", F.when(
        F.col("predicate") == "establishes", "add_assertion").otherwise("remove_assertion"))
    kept, held = P.hold_back(operations, 0.8)
    return kept.agg(F.lit("kept").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(
        held.agg(F.lit("held").alias("part"), F.count(F.lit(1)).alias("n")))


TOKENS = "list_distinct(list_filter(regexp_split_to_array(replace(lower(strip_accents({0})), 'ß', 'ss'), '\\s+'), " \
         "lambda w: w <> ''))"


@query("P14_minimal_edit", f"""WITH k AS (SELECT a.conv_id, a.turn, trim(a.text) AS o, trim(b.text) AS n
      FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    j AS (SELECT *, {TOKENS.format('o')} AS ow, {TOKENS.format('n')} AS nw FROM k)
    SELECT conv_id, turn, CASE WHEN n IS NULL OR n = '' THEN 'empty' WHEN n = o THEN 'unchanged'
      WHEN len(ow) > 0 AND len(list_intersect(ow, nw)) / len(ow) < 0.35 THEN 'rewritten'
      END AS reason FROM j""")
def p14(t):
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("old"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"),
                               F.col("text").alias("new"))
    return a.join(b, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", P.draft_reason(F.col("old"), F.col("new")).alias("reason"))


@query("P15_dedupe_key", with_("facts", then="""SELECT assertion_id, subject_kind || '|' ||
    coalesce(subject_entity_id, subject_scene_id) || '|' || predicate || '|' || object_kind || '|' ||
    coalesce(object_entity_id, object_scene_id) || '|' || source_unit_id AS dedupe_key FROM facts"""))
def p15(t):
    return t.facts.select("assertion_id", P.dedupe_key().alias("dedupe_key"))


@query("P16_evidence_span", """SELECT doc_id, CASE WHEN length(text) >= 900 THEN
    substr(text, 801, 100) END AS quote FROM documents""")
def p16(t):
    return t.documents.select("doc_id", words.quoted(F.lit(800), F.lit(900), F.col("text"))
                              .alias("quote"))


@query("P17_scene_body", """SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles
    FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def p17(t):
    units = t.conversations.select(
        F.col("conv_id").alias("scene_id"), F.col("turn").alias("sequence_index"),
        F.expr("CASE role WHEN 'system' THEN 'scene_heading' ELSE role END").alias("unit_type"),
        F.col("role").alias("text"))
    scenes = units.select("scene_id").distinct().withColumn("omitted", F.lit(False))
    body = P.scene_bodies(scenes, units)
    return body.select(F.col("scene_id").alias("conv_id"), F.size("texts").cast("long").alias("n"),
                       F.array_join("texts", ",").alias("roles"))


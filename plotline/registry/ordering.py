"""Sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F


from plotline.operators import filters as P
from plotline.operators import joins as J
from plotline.operators import lists
from plotline.registry import query
from plotline.registry.joins import FINDINGS, PAIRS_SQL, surfaces
from plotline.sources.tables import with_


@query("O1_paged_list", """WITH m AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k,
      count(*) OVER () AS n FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'mach'))
    SELECT c_custkey, k FROM m WHERE (k - 1) // 50 + 1 = least(2, greatest(1, CAST(ceil(n / 50.0) AS BIGINT)))""")
def o1(t):
    listing = lists.page(t.customer, ["c_name", "c_mktsegment"], "c_acctbal", True, "c_custkey",
                         lists.opens_ascending("c_acctbal", "c_name", True), 2, 50, "Mach")
    return listing.rows.select("c_custkey", F.col("_k").cast("long").alias("k"))


@query("O1_page_totals", """SELECT count(*) AS total, count(*) FILTER (contains(lower(c_name || ' ' ||
      c_mktsegment), 'mach')) AS matching, CAST(ceil(count(*) FILTER (contains(lower(c_name || ' ' ||
      c_mktsegment), 'mach')) / 50.0) AS BIGINT) AS pages FROM customer""")
def o1_totals(t):
    listing = lists.page(t.customer, ["c_name", "c_mktsegment"], "c_acctbal", True, "c_custkey",
                         False, 999, 50, "Mach")
    return listing.totals.drop("page")


@query("O2_lead_first", """SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 40 THEN 1 ELSE 0 END
    DESC, lower(p_name), p_partkey) AS k FROM part ORDER BY k LIMIT 25""")
def o2(t):
    rows = t.part.withColumn("lead", F.col("p_size") > 40)
    return lists.page(rows, ["p_name"], "p_name", False, "p_partkey", True, lead="lead").rows.select(
        "p_partkey", F.col("_k").cast("long").alias("k"))


@query("O3_rank_mapped_order", "WITH " + FINDINGS + """ SELECT finding_id, row_number() OVER (
    ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
    CASE status WHEN 'open' THEN 3 WHEN 'dismissed' THEN 2 ELSE 1 END DESC, finding_id) AS k
    FROM findings ORDER BY k LIMIT 200""")
def o3(t):
    w = J.findings(t).withColumn("a", lists.weight(F.col("severity"), lists.SEVERITY_WEIGHT)).withColumn(
        "b", lists.weight(F.col("status"), lists.STATUS_WEIGHT)).withColumn("_all", F.lit(1))
    return P.first_in(w, ["_all"], [F.col("a").desc(), F.col("b").desc(), F.col("finding_id")], 200, "k"
                      ).select("finding_id", F.col("k").cast("long").alias("k"))


@query("O4_ranked_evidence", with_("scenes", "facts", "assertions", then="""SELECT script_id, assertion_id, k, n > 40
      AS truncated FROM (SELECT a.script_id, assertion_id, row_number() OVER (PARTITION BY a.script_id
      ORDER BY 120 - 0.5 * least(abs(sequence_index - 4), 50) DESC, sequence_index, assertion_id) AS k,
      count(*) OVER (PARTITION BY a.script_id) AS n FROM assertions a JOIN scenes s USING (scene_id)
      WHERE active) WHERE k <= 40"""))
def o4(t):
    from plotline.plans.continuity import ranked
    rows = P.active(t.assertions).join(
        t.ordered_scenes.select("scene_id", "sequence_index"), "scene_id").withColumns(
        {"origin_index": F.lit(4), "relevant": F.lit(True), "request_id": F.col("script_id")})
    return ranked(rows).select("script_id", "assertion_id", F.col("place").cast("long").alias("k"),
                               "truncated")


@query("O5_plain_limits", with_("facts", then="""SELECT scene_id, assertion_id FROM (SELECT scene_id, assertion_id,
    row_number() OVER (PARTITION BY scene_id ORDER BY assertion_id) AS k FROM facts WHERE active)
    WHERE k <= 3"""))
def o5(t):
    return P.first_in(P.active(t.facts), ["scene_id"], [F.col("assertion_id")], 3).select(
        "scene_id", "assertion_id")


@query("O6_find_scene", with_("scenes", then="""SELECT request_id, coalesce(
      (SELECT min_by(scene_id, sequence_index) FROM scenes s WHERE s.script_id = r.script_id AND number = w),
      (SELECT min_by(scene_id, sequence_index) FROM scenes s WHERE s.script_id = r.script_id
        AND CAST(sequence_index + 1 AS VARCHAR) = w),
      (SELECT min_by(scene_id, sequence_index) FROM scenes s WHERE s.script_id = r.script_id
        AND lower(heading) = lower(w))) AS scene_id
    FROM (SELECT o_orderkey AS request_id, o_custkey AS script_id, CASE WHEN o_orderstatus = 'F' THEN
      o_orderpriority ELSE CAST(o_orderkey % 20 AS VARCHAR) END AS w FROM orders) r"""))
def o6(t):
    asked = t.orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("script_id"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderpriority "
               "ELSE 'Scene ' || (o_orderkey % 20) || '.' END").alias("wanted"))
    return lists.find_scenes(asked, t.ordered_scenes).select("request_id", "scene_id")


@query("O6_natural_order", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY
      CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 50 END,
      CASE WHEN o_orderstatus = 'P' THEN (o_orderkey % 50) || 'A' ELSE (o_orderkey % 50)::VARCHAR END,
      o_orderkey) AS k FROM orders QUALIFY k <= 3""")
def o6_order(t):
    rows = t.orders.withColumn("number", F.expr(
        "CASE WHEN o_orderstatus = 'P' THEN (o_orderkey % 50) || 'A' ELSE '' || (o_orderkey % 50) END"))
    return P.first_in(rows, ["o_custkey"], [*lists.natural_scene_key(F.col("number")), F.col("o_orderkey")],
                      3, "k").select("o_orderkey", F.col("k").cast("long").alias("k"))


@query("O7_pair_ranking", PAIRS_SQL.replace("SELECT DISTINCT script_id, entity_type, a_id, b_id FROM p", """
    SELECT keep_id, absorb_id FROM (SELECT
      CASE WHEN length(y.name) > length(x.name) THEN b_id ELSE a_id END AS keep_id,
      CASE WHEN length(y.name) > length(x.name) THEN a_id ELSE b_id END AS absorb_id
      FROM (SELECT DISTINCT * FROM p) q JOIN e x ON x.entity_id = a_id JOIN e y ON y.entity_id = b_id)"""))
def o7(t):
    from plotline.plans.duplicates import detect
    spark = t.spark
    none = spark.createDataFrame([], "entity_id long, normalized_alias string")
    apart = spark.createDataFrame([], "a_id long, b_id long")
    cited = spark.createDataFrame([], "entity_id long, cited long")
    return detect(surfaces(t), none, apart, cited).select("keep_id", "absorb_id")


@query("O8_newest_first", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def o8(t):
    return lists.newest(t.events, "ts", "event_id", 1000).select("event_id")



"""The graph tables of one folder, each with a declared schema.

The star-schema and text tables are read as engine tables:

* scripts     <- customer               * entities   <- part (script = brand)
* scenes      <- orders                 * assertions <- lineitem with orders
* model calls <- events                 * documents, conversations <- themselves
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.session import spread

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, "
              "value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
               partitions: int, **options: str) -> DataFrame:
    """The same scan from a relational store, split on a numeric key."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key,
            lowerBound=lower, upperBound=upper, numPartitions=partitions, **options).load())


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def scripts(self) -> DataFrame:
        """One script per customer; every third chain member starts a new chain."""
        return self.customer.select(
            F.col("c_custkey").alias("script_id"), F.col("c_name").alias("title"),
            F.expr(IMPORT_STATUS).alias("import_status"),
            F.expr(GRAPH_STATUS).alias("graph_status"),
            F.expr("CASE WHEN c_acctbal > 0 THEN c_acctbal END").alias("opened_at"),
            F.expr("CASE WHEN c_custkey % 3 <> 0 THEN c_custkey - 1 END")
            .alias("predecessor_script_id"),
            (F.col("c_nationkey") + 1).cast("long").alias("current_version"))

    @cached_property
    def scenes(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("scene_id"), F.col("o_custkey").alias("script_id"),
            F.col("o_orderdate").alias("scene_date"),
            F.expr(SCENE_NUMBER).alias("number"),
            F.col("o_orderpriority").alias("heading"),
            (F.col("o_orderpriority") == "5-LOW").alias("omitted"))

    @cached_property
    def ordered_scenes(self) -> DataFrame:
        """Scenes with their 0-based position inside the script."""
        from plotline.operators.scans import ordinal
        return ordinal(
            self.scenes, ["script_id"], [F.col("scene_date"), F.col("scene_id")], "_n"
        ).withColumn("sequence_index", F.col("_n") - 1).drop("_n")

    @cached_property
    def entities(self) -> DataFrame:
        """One entity per (script, type, name); the lowest part number is its id."""
        return (self.part.select("p_brand", F.expr(ENTITY_TYPE).alias("entity_type"),
                                 "p_name", "p_partkey")
                .groupBy(F.col("p_brand").alias("script_id"), "entity_type",
                         F.col("p_name").alias("canonical_name"))
                .agg(F.min("p_partkey").alias("entity_id")))

    @cached_property
    def facts(self) -> DataFrame:
        """Assertions without the script, straight from one scan of lineitem."""
        return self.facts_of(self.lineitem)

    def facts_of(self, lines: DataFrame, *more: str) -> DataFrame:
        """The facts of some rows of lineitem, with more of their columns."""
        scene, part, supp = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey"))
        is_edge = F.col("l_returnflag") == "R"
        return lines.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            .alias("assertion_id"),
            F.when(is_edge, "entity").otherwise("scene").alias("subject_kind"),
            F.when(is_edge, supp).alias("subject_entity_id"),
            F.when(~is_edge, scene).alias("subject_scene_id"),
            F.expr(PREDICATE).alias("predicate"),
            F.lit("entity").alias("object_kind"), part.alias("object_entity_id"),
            F.lit(None).cast("long").alias("object_scene_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_unit_id"),
            scene.alias("scene_id"),
            F.round(F.lit(1.0) - F.col("l_discount") * 5, 2).alias("confidence"),
            (F.col("l_linestatus") == "O").alias("active"),
            F.col("l_shipdate").alias("created_at"), *more)

    @cached_property
    def assertions(self) -> DataFrame:
        return self.owned(self.facts)

    def owned(self, facts: DataFrame) -> DataFrame:
        """Facts with the script of their scene."""
        owner = self.orders.select(F.col("o_orderkey").alias("scene_id"),
                                   F.col("o_custkey").alias("script_id"))
        return facts.join(owner, "scene_id")

    @cached_property
    def texts(self) -> DataFrame:
        """Documents, over all cores, for work that reads whole texts."""
        return spread(self.documents, "doc_id")

    @cached_property
    def model_calls(self) -> DataFrame:
        """Calls from events: purpose by type, tokens from the JSON payload."""
        tokens = F.get_json_object("props", "$.k").cast("long")
        return self.events.select(
            F.col("event_id").alias("call_id"), F.col("ts").alias("created_at"),
            F.expr(PURPOSE).alias("purpose"), F.col("user_id").alias("script_id"),
            F.expr("CASE WHEN event_type = 'click' AND value > 50 THEN event_id div 4 END")
            .alias("change_set_id"),
            F.expr("CASE WHEN value < 5 THEN NULL ELSE event_id % 23 END").alias("scene_number"),
            F.expr(MODEL).alias("model_id"),
            F.expr("CASE WHEN value >= 1 THEN CAST(get_json_object(props, '$.k') AS BIGINT) END")
            .alias("input_tokens"),
            F.expr("CAST(floor(value) AS BIGINT)").alias("output_tokens"),
            F.when(F.col("event_type") == "error", tokens).alias("reasoning_tokens"),
            F.expr(OUTCOME).alias("outcome"))


# Mappings valid in Spark and in the checking SQL alike.
IMPORT_STATUS = ("CASE c_mktsegment WHEN 'MACHINERY' THEN 'accepted_with_warnings' "
                 "WHEN 'HOUSEHOLD' THEN 'needs_review' ELSE 'accepted' END")
GRAPH_STATUS = ("CASE WHEN c_nationkey < 10 THEN 'ready' WHEN c_nationkey < 15 "
                "THEN 'partially_ready' ELSE 'not_analysed' END")
SCENE_NUMBER = ("CASE WHEN o_orderstatus = 'P' THEN NULL "
                "ELSE CAST(o_orderkey % 400 AS STRING) END")
ENTITY_TYPE = ("CASE p_type WHEN 'STANDARD' THEN 'prop' WHEN 'ECONOMY' THEN 'wardrobe' "
               "WHEN 'SMALL' THEN 'set_design' WHEN 'PROMO' THEN 'vfx' "
               "WHEN 'MEDIUM' THEN 'transportation' ELSE 'cast' END")
PREDICATE = ("CASE l_returnflag WHEN 'A' THEN 'requires' WHEN 'N' THEN 'establishes' "
             "ELSE 'uses' END")
PURPOSE = ("CASE event_type WHEN 'view' THEN 'extract' WHEN 'click' THEN 'judge' "
           "WHEN 'signup' THEN 'continuity' WHEN 'error' THEN 'agent' ELSE 'query' END")
MODEL = ("CASE WHEN user_id % 3 = 0 THEN 'small' WHEN user_id % 3 = 1 THEN 'large' "
         "ELSE 'unpriced' END")
OUTCOME = ("CASE WHEN value > 200 THEN 'cached' WHEN value < 1 THEN 'provider_error' "
           "ELSE 'ok' END")

# The same frames as SQL text, for the checking queries.
SQL = {
    "scripts": f"""scripts AS (SELECT c_custkey AS script_id, c_name AS title,
        {IMPORT_STATUS} AS import_status, {GRAPH_STATUS} AS graph_status,
        CASE WHEN c_acctbal > 0 THEN c_acctbal END AS opened_at,
        CASE WHEN c_custkey % 3 <> 0 THEN c_custkey - 1 END AS predecessor_script_id,
        c_nationkey + 1 AS current_version FROM customer)""",
    "scenes": f"""scenes AS (SELECT o_orderkey AS scene_id, o_custkey AS script_id,
        o_orderdate AS scene_date, {SCENE_NUMBER} AS number, o_orderpriority AS heading,
        o_orderpriority = '5-LOW' AS omitted,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1
        AS sequence_index FROM orders)""",
    "entities": f"""entities AS (SELECT p_brand AS script_id, {ENTITY_TYPE} AS entity_type,
        p_name AS canonical_name, min(p_partkey) AS entity_id FROM part GROUP BY 1, 2, 3)""",
    "facts": f"""facts AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-'
        || l_suppkey AS assertion_id,
        CASE WHEN l_returnflag = 'R' THEN 'entity' ELSE 'scene' END AS subject_kind,
        CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS subject_entity_id,
        CASE WHEN l_returnflag <> 'R' THEN l_orderkey END AS subject_scene_id,
        {PREDICATE} AS predicate, 'entity' AS object_kind, l_partkey AS object_entity_id,
        CAST(NULL AS BIGINT) AS object_scene_id,
        l_orderkey || '-' || l_linenumber AS source_unit_id, l_orderkey AS scene_id,
        round(1.0 - l_discount * 5, 2) AS confidence, l_linestatus = 'O' AS active,
        l_shipdate AS created_at FROM lineitem)""",
    "assertions": """assertions AS (SELECT f.*, o_custkey AS script_id
        FROM facts f JOIN orders ON o_orderkey = scene_id)""",
    "calls": f"""calls AS (SELECT event_id AS call_id, ts AS created_at, {PURPOSE} AS purpose,
        user_id AS script_id,
        CASE WHEN event_type = 'click' AND value > 50 THEN event_id // 4 END AS change_set_id,
        CASE WHEN value < 5 THEN NULL ELSE event_id % 23 END AS scene_number, {MODEL} AS model_id,
        CASE WHEN value >= 1 THEN CAST(props ->> '$.k' AS BIGINT) END AS input_tokens,
        CAST(floor(value) AS BIGINT) AS output_tokens,
        CASE WHEN event_type = 'error' THEN CAST(props ->> '$.k' AS BIGINT) END
        AS reasoning_tokens, {OUTCOME} AS outcome FROM events)""",
}


def with_(*names: str, then: str) -> str:
    """A checking query over the named frames."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + then

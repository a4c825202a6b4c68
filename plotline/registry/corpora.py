"""Documents in each source format, derived by Spark from the given tables.

The given tables hold no screenplays. These frames lay every conversation (or
document) out as a script, a play, Final Draft XML or positioned lines, so the
parsers read whole tables and the units they must return are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLEAN = r"'So ' || trim(regexp_replace(text, '\s+', ' ', 'g'))"

# The units of each conversation as SQL text: three turns a scene; a system turn is
# action, any other turn is a cue with its speech.
UNITS_SQL = rf"""t AS (SELECT conv_id AS script_id, turn // 3 AS scene_index, turn % 3 AS k,
      upper(role) AS speaker, role = 'system' AS is_action, {CLEAN} AS body FROM conversations),
    u AS (SELECT script_id, scene_index, 0 AS k, 'scene_heading' AS unit_type,
        'INT. ROOM ' || scene_index || ' - DAY' AS text, NULL AS speaker FROM t GROUP BY 1, 2
      UNION ALL SELECT script_id, scene_index, 1 + k * 2, CASE WHEN is_action THEN 'action' ELSE 'character'
        END, CASE WHEN is_action THEN body ELSE speaker END, CASE WHEN NOT is_action THEN speaker END FROM t
      UNION ALL SELECT script_id, scene_index, 2 + k * 2, 'dialogue', body, speaker FROM t
        WHERE NOT is_action),
    units AS (SELECT *, row_number() OVER (PARTITION BY script_id, scene_index ORDER BY k) - 1
      AS sequence_index FROM u)"""


def script_units(t) -> DataFrame:
    """script_id, scene_index, sequence_index, unit_type, text, speaker."""
    body = F.concat(F.lit("So "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    rows = t.conversations.select(
        F.col("conv_id").alias("script_id"), F.expr("turn div 3").alias("scene_index"),
        (F.col("turn") % 3).alias("k"), F.upper("role").alias("speaker"),
        (F.col("role") == "system").alias("is_action"), body.alias("body"))
    none = F.lit(None).cast("string")

    def unit(k, kind, text, speaker):
        return F.struct(k.cast("long").alias("sequence_index"), F.lit(kind).alias("unit_type"),
                        text.alias("text"), speaker.alias("speaker"))
    at = F.col("k") * 2 + 1
    pair = F.array(unit(at, "character", F.col("speaker"), F.col("speaker")),
                   unit(at + 1, "dialogue", F.col("body"), F.col("speaker")))
    spoken = rows.select("script_id", "scene_index", F.explode(F.when(
        F.col("is_action"), F.array(unit(at, "action", F.col("body"), none))).otherwise(pair)).alias("u"))
    heads = rows.select("script_id", "scene_index").distinct().withColumn("u", unit(
        F.lit(0), "scene_heading", F.concat(F.lit("INT. ROOM "), "scene_index", F.lit(" - DAY")), none))
    rows = heads.unionByName(spoken).select("script_id", "scene_index", "u.*")
    scene = Window.partitionBy("script_id", "scene_index").orderBy("sequence_index")
    return rows.withColumn("sequence_index", F.row_number().over(scene).cast("long") - 1)


def script_frames(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scripts, scenes, units) of the conversations."""
    units = script_units(t)
    scenes = units.filter("unit_type = 'scene_heading'").select(
        "script_id", "scene_index", F.col("text").alias("heading"), F.lit(False).alias("omitted"))
    scripts = t.conversations.select(F.col("conv_id").alias("script_id")).distinct().withColumn(
        "title", F.concat(F.lit("Script "), "script_id"))
    return scripts, scenes, units


def fountain_texts(t) -> DataFrame:
    from plotline.sources.sink import export_fountain
    return export_fountain(*script_frames(t)).select(F.col("script_id").alias("doc_id"), "text")


def fdx_texts(t) -> DataFrame:
    """Final Draft XML; one speech in two style runs, an unknown type, an ignored one."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))
    kind = F.initcap(F.translate("unit_type", "_", " "))
    kind = F.when(F.col("unit_type") == "action", "Stage Note").otherwise(kind)
    number = F.when(F.col("unit_type") == "scene_heading",
                    F.concat(F.lit(' Number="'), F.col("scene_index") + 1, F.lit('A"'))).otherwise("")
    split = F.when(F.col("unit_type") == "dialogue", F.concat(
        F.lit("<Text>"), F.left("safe", F.lit(1)), F.lit("</Text><Text>"),
        F.substr("safe", F.lit(2)), F.lit("</Text>"))).otherwise(
        F.concat(F.lit("<Text>"), "safe", F.lit("</Text>")))
    units = script_units(t).withColumn("safe", safe)
    units = units.withColumn("safe", F.when(F.substr("text", F.lit(1), F.lit(1)).isin("&", "<", ">"),
                                            F.concat(F.lit("x"), "safe")).otherwise(F.col("safe")))
    para = F.concat(F.lit('<Paragraph Type="'), kind, F.lit('"'), number, F.lit(">"), split,
                    F.lit("</Paragraph>"))
    body = units.withColumn("para", para).groupBy("script_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("scene_index", "sequence_index", "para"))),
        lambda p: p["para"]), "").alias("body"))
    return body.select(F.col("script_id").alias("doc_id"), F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<FinalDraft DocumentType="Script"><Content>'
              '<Paragraph Type="Cast List"><Text>CAST</Text></Paragraph>'), "body",
        F.lit("</Content></FinalDraft>")).alias("text"))


def play_texts(t) -> DataFrame:
    """A printed play: contents, an act, numbered scenes, cues, hard-wrapped speech."""
    rows = t.conversations.select(
        F.col("conv_id").alias("doc_id"), "turn",
        F.concat(F.when(F.col("turn") % 3 == 0, F.concat(
            F.lit("SCENE "), F.expr("turn div 3 + 1"), F.lit(". A room of the house.\n\n"))).otherwise(""),
            F.upper("role"), F.lit("\n"), F.trim("text"), F.lit("\n")).alias("part"))
    return rows.groupBy("doc_id").agg(F.concat(
        F.lit("CONTENTS\n\nACT II\nSCENE 1. A room of the house.\n\nDramatis Personae\nOld man\n\nACT II\n\n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))),
                                 lambda p: p["part"]), "\n"), F.lit("\nTHE END\n\nfootnote\n")).alias("text"))


def positioned_lines(t) -> DataFrame:
    """Document lines placed on pages of forty: headings, action, cues and speech."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "body"))
    k = F.col("n") % 5
    text = (F.when(F.col("n") == 0, F.concat(F.lit("7A INT. HALL "), "doc_id", F.lit(" - DAY 7A")))
            .when(k == 3, F.concat(F.lit("NAME "), F.col("n") % 7)).otherwise(F.concat(F.lit("x "), F.trim("body"))))
    x = F.when(F.col("n") == 0, 72.0).when(k == 3, 212.0).when(k == 4, 132.0).otherwise(72.0)
    y = (F.col("n") % 40) * -30.0 + F.when(k == 4, 18.0).otherwise(0.0)
    return rows.select("doc_id", (F.expr("n div 40") + 1).cast("long").alias("page"),
                       (F.col("n") % 40).cast("int").alias("pos"), x.alias("x"), y.alias("y"),
                       text.alias("text"), "n")


def truth_texts(t) -> DataFrame:
    """One ground-truth document per part with all four tables."""
    bar = "`prop` or `vfx`"
    text = F.concat(
        F.lit("# P: ground truth\n\n| Canonical Name | Type | Aliases |\n|---|---|---|\n| "), "p_name",
        F.lit(f" | {bar} | The "), "p_name", F.lit(", "), "p_brand",
        F.lit(" |\n\nprose | not a table\n\n| Entity | Key | Value |\n|:--|---|---|\n| "), "p_name",
        F.lit(" | size | "), "p_size", F.lit(" |\n| "), "p_name", F.lit(" | brand | "), "p_brand",
        F.lit(" |\n\n| Entity | Type | Establishes | Dependants |\n|---|---|---|---|\n| "), "p_name",
        F.lit(" | `prop` | scene "), "p_size", F.lit("A only | 5 (as NAME), 32B and "), "p_partkey",
        F.lit(" |\n\n## Scene "), "p_size", F.lit(" edges\n| Subject | Predicate | Object | Confidence |\n"
                                                  "|---|---|---|---|\n| Sc "), "p_size",
        F.lit(" | `requires` | "), "p_name", F.lit(" | Medium |\n"))
    return t.part.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))

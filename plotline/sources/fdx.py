"""Final Draft XML. Spark's XML reader takes the document apart; the rest is columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions import headings as H
from plotline.functions.text import strip
from plotline.session import durable
from plotline.sources.lines import doc_so_far
from plotline.sources.parsing import UNIT_COLUMNS, scene_units

SCHEMA = ("Content struct<Paragraph: array<struct<_Type: string, _Number: string, "
          "Text: array<string>>>>, TitlePage struct<Content: struct<Paragraph: "
          "array<struct<Text: array<string>>>>>, _corrupt_record string")

def parsed(texts: DataFrame) -> DataFrame:
    """Adds ``x`` and the rejection a document earns as XML, if any."""
    text = F.col("text")
    # Entity declarations are refused unread; they are how a small file grows without bound.
    unsafe = text.rlike(r"(?i)<!ENTITY")
    body = F.regexp_replace(text, r"(?s)^\s*<\?xml.*?\?>|<!DOCTYPE[^>\[]*>", "")
    x = F.from_xml(F.when(~unsafe, body), SCHEMA, {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false",
                                                  "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = texts.withColumn("x", x).withColumn("_root", F.regexp_extract(
        body, r"^\s*(?:<!--.*?-->\s*)*<\s*([A-Za-z_][\w.\-]*)", 1))
    broken = F.col("x._corrupt_record").isNotNull() | F.col("x").isNull()
    return rows.withColumn("rejection", F.when(unsafe, "xml_unsafe").when(broken, "xml_malformed")
                           .when(F.col("_root") != "FinalDraft", "fdx_wrong_root")
                           .when(F.col("x.Content").isNull(), "fdx_no_content")).drop("_root")


def final_draft(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scenes, units, rejects) of a corpus of Final Draft documents (doc_id, text)."""
    docs = parsed(texts)
    rejects = docs.filter("rejection IS NOT NULL").select("doc_id", "rejection")
    rows = docs.filter("rejection IS NULL").select(
        "doc_id", F.posexplode("x.Content.Paragraph").alias("pos", "p"))
    kinds = F.create_map(*[F.lit(v) for kv in vocab.FDX_PARAGRAPH_TYPES.items() for v in kv])
    key = F.lower(strip(F.coalesce("p._Type", F.lit("General"))))
    text = strip(F.array_join("p.Text", ""))
    rows = rows.withColumns({
        "key": key, "text": text, "unknown": kinds[key].isNull(),
        "base": F.coalesce(kinds[key], F.lit("action"))}).filter(
        ~F.col("key").isin(*vocab.FDX_IGNORED_TYPES) & (F.col("text") != ""))
    heading = F.col("base") == "scene_heading"
    rows = rows.withColumn("_h", F.sum(heading.cast("int")).over(doc_so_far()))
    early = F.max(F.col("_h") == 0).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("early", early).withColumn(
        "scene_index", F.col("_h") - F.when(F.col("early"), 0).otherwise(1))
    kind = F.when((F.col("base") == "action") & H.is_shot(F.col("text")), "shot").otherwise(
        F.col("base"))
    named = F.when(kind == "character", F.coalesce(H.cue(F.col("text"))["name"], F.col("text"))).when(
        heading, F.lit(""))
    rows = rows.withColumn("unit_type", kind).withColumn("_name", named)
    speaker = F.nullif(F.last("_name", ignorenulls=True).over(doc_so_far()), F.lit(""))
    spoken = F.col("unit_type").isin("character", "dialogue", "parenthetical")
    rows = rows.withColumn("speaker", F.when(spoken, speaker))
    rows = durable(rows.select("doc_id", "pos", "scene_index", "unit_type", "text", "speaker", "base", "early",
                               F.col("p._Number").alias("stated"), "unknown", "key"))
    bare = H.without_number(F.col("text"))
    split = H.split_heading(bare)
    scenes = rows.filter(heading).select(
        "doc_id", "scene_index", bare.alias("heading"),
        F.coalesce("stated", H.scene_number(F.col("text"))).alias("number"),
        split["int_ext"].alias("int_ext"), split["time_of_day"].alias("time_of_day")).unionByName(
        rows.filter("early").select("doc_id").distinct().select(
            "doc_id", F.lit(0).cast("long").alias("scene_index"), F.lit("").alias("heading"),
            F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("int_ext"),
            F.lit(None).cast("string").alias("time_of_day")))
    units = rows.withColumns({
        "sequence_index": F.row_number().over(scene_units().orderBy("pos")) - 1,
        "confidence": F.lit(1.0), "method": F.lit("fdx"), "start": F.col("pos"),
        "end": F.col("pos")})
    return scenes, units.select(*UNIT_COLUMNS, "unknown", "key"), rejects

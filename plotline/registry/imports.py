"""A corpus of mixed formats through the whole import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.plans import imports
from plotline.registry import corpora, query
from plotline.registry.sources import _HEAD
from plotline.session import new_folder
from plotline.sources.ingest import SNIFF


def payloads(t) -> DataFrame:
    """Every conversation as Fountain, Final Draft XML or plain text, every document as PDF bytes, XML or prose."""
    third = F.col("doc_id") % 3
    scripts = corpora.fountain_texts(t).filter(third != 1)
    untitled = F.regexp_replace("text", r"(?s)\ATitle: [^\n]*\n", "")
    scripts = scripts.select("doc_id", F.when(third == 0, F.col("text")).otherwise(untitled).alias("text"),
                             F.when(third == 0, "fountain").otherwise("txt").alias("kind"))
    drafts = corpora.fdx_texts(t).filter(third == 1).select("doc_id", "text", F.lit("fdx").alias("kind"))
    talks = scripts.unionByName(drafts).select(
        F.concat(F.lit("c"), "doc_id").alias("doc_id"), F.encode("text", "UTF-8").alias("content"),
        F.concat(F.lit("talks/My_talk-"), "doc_id", F.lit("."), "kind").alias("source_name"))
    body = F.when(third == 0, F.concat(F.lit("%PDF-1.4 "), "text")).when(
        third == 1, F.concat(F.lit("<?xml version='1.0'?><page>"), "text", F.lit("</page>"))).otherwise(F.col("text"))
    prose = t.texts.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.encode(body, "UTF-8").alias("content"),
                           F.concat(F.lit("prose/"), "doc_id", F.lit(".txt")).alias("source_name"))
    return talks.unionByName(prose)


# Prose with a line that reads as a heading has a scene, and too little else.
HEADED = rf"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x, E' \t\r\x0b\x0c'), '{_HEAD}'))) > 0"

# Text whose first bytes, read as Latin-1, hold a zero or too few that print is taken for a binary file.
BINARY = f"""list_bool_or(list_transform([regexp_extract_all(left(hex(encode(text)), {2 * SNIFF}), '..')], lambda b: list_contains(b, '00') OR
      len(list_filter(b, lambda h: regexp_matches(h, '^(09|0A|0D|[2-6A-F].|7[0-9A-E])$'))) < 0.85 * len(b)))"""
NO_TEXT = "(trim(text, E' \\t\\r\\n') = '' OR " + BINARY + ")"


@query("S12_import_corpus", "WITH " + corpora.UNITS_SQL + """, n AS (SELECT script_id AS id, script_id % 3 AS k, count(DISTINCT scene_index) AS scenes,
      count(*) AS units, count(*) FILTER (unit_type = 'character') > 0 AND count(*) FILTER (unit_type = 'dialogue') > 0 AS talks,
      count(*) FILTER (unit_type = 'dialogue') / count(*) >= 0.08 AS much, avg(length(text)) FILTER (unit_type = 'action') AS mean,
      count(*) FILTER (unit_type = 'action') > 0 AS acted FROM units GROUP BY 1, 2),
    v AS (SELECT *, CASE WHEN scenes >= 3 THEN 35 ELSE 0 END + CASE WHEN talks THEN 35 ELSE 0 END + CASE WHEN much THEN 20 ELSE 0 END
      + CASE WHEN mean <= 700 THEN 10 ELSE 0 END AS score, scenes < 3 OR NOT talks OR NOT much OR coalesce(mean > 700, false) AS weak FROM n)
    SELECT 'c' || id AS doc_id, CASE k WHEN 0 THEN 'fountain' WHEN 1 THEN 'fdx' ELSE 'plain_text' END AS format,
      CASE k WHEN 0 THEN 'Script ' || id ELSE 'My talk ' || id END AS title,
      CASE WHEN score < 50 THEN 'rejected' WHEN weak OR k = 2 THEN 'needs_review' WHEN k = 1 AND acted THEN 'accepted_with_warnings'
        ELSE 'accepted' END AS outcome, CASE WHEN score < 50 THEN 'not_a_screenplay' END AS rejection,
      CASE WHEN score < 50 THEN 0 ELSE scenes END AS scenes, CASE WHEN score < 50 THEN 0 ELSE units END AS units FROM v
    UNION ALL SELECT 'd' || doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pdf' WHEN doc_id % 3 = 1 OR """ + NO_TEXT + """ THEN 'unknown'
      ELSE 'plain_text' END, doc_id::VARCHAR, 'rejected', CASE WHEN doc_id % 3 < 2 OR """ + NO_TEXT + """ THEN 'unsupported_format'
      WHEN """ + HEADED + """ THEN 'not_a_screenplay' ELSE 'no_scenes' END, 0, 0 FROM documents""")
def import_corpus(t):
    """Counts are those of the snapshot that the manifest names."""
    folder = new_folder(t.spark, "corpus")
    imports.publish(imports.import_corpus(payloads(t)), folder)
    made = imports.published(t.spark, folder)
    rows = made["imports"].select("doc_id", "format", "title", "outcome", "rejection")
    for name in ("scenes", "units"):
        rows = rows.join(made[name].groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)), "doc_id", "left")
    return rows.na.fill(0, ["scenes", "units"])

"""S1-S13 as one dataflow: payloads of any format in, outcomes and one published snapshot of tables out.

Each payload is hashed, decoded and typed once; each format's documents pass that format's
parser; limits, the screenplay verdict and the outcome hold for all of them together.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline import vocab
from plotline.operators import aggregates
from plotline.session import durable
from plotline.sources import fdx, ingest, parsing, stage

Parsed = dict[str, DataFrame]
SCENES = "scene_index long, heading string, number string, int_ext string, time_of_day string"
WARNINGS = "code string, scene_index long"
MANIFEST = "listed_at long, snapshot string, table string, rows long, schema string"
TABLES = ("imports", "warnings", "scripts", "scenes", "units")


def _three(parse: Callable) -> Callable[[DataFrame], Parsed]:
    def run(texts):
        scenes, units, warnings = parse(texts)
        return {"scenes": scenes, "units": units, "warnings": warnings}
    return run


def _final_draft(texts: DataFrame) -> Parsed:
    scenes, units, rejects = fdx.final_draft(texts)
    none = F.lit(None).cast("long")
    unknown = units.filter("unknown").select("doc_id").distinct().select(
        "doc_id", F.lit("unknown_paragraph_type").alias("code"), none.alias("scene_index"))
    return {"scenes": scenes, "units": units, "warnings": unknown, "rejects": rejects}


# format -> texts (doc_id, text) to scenes, units, warnings and, where a format has them, rejects.
FORMATS: dict[str, Callable[[DataFrame], Parsed]] = {
    "fountain": _three(parsing.fountain), "plain_text": _three(parsing.plain),
    "stage_play": _three(stage.stage_play), "fdx": _final_draft}


def _shaped(frame: DataFrame, columns: str) -> DataFrame:
    """``doc_id`` and the named columns in their types; null where the frame has none."""
    typed = [c.split() for c in columns.split(", ")]
    return frame.select("doc_id", *[
        (F.col(name) if name in frame.columns else F.lit(None)).cast(kind).alias(name) for name, kind in typed])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def received(payloads: DataFrame, formats: dict[str, Callable] = FORMATS) -> DataFrame:
    """doc_id, source_name, content_hash, size, format, confidence, title, text, rejection.

    The content of a payload over the size limit goes no further than its length, so every
    text a parser sees is within that limit.
    """
    rows = ingest.identify(payloads)
    rows = rows.withColumn("content", F.when(F.col("rejection").isNull(), F.col("content")))
    rows = ingest.detect(ingest.decode(rows))
    no_parser = F.when(~F.col("format").isin(*formats), "unsupported_format")
    early = F.when((F.col("rejection") == "payload_too_large") | (F.col("format") != "pdf"), F.col("rejection"))
    title = ingest.title(F.when(F.col("format") == "fountain", ingest.fountain_title(F.col("text"))), F.col("source_name"))
    return rows.select("doc_id", "source_name", "content_hash", "size", "format", "confidence", title.alias("title"),
                       "text", F.coalesce(early, no_parser).alias("rejection"))


def parsed(rows: DataFrame, formats: dict[str, Callable] = FORMATS) -> Parsed:
    """Scenes, units, warnings and rejects of all formats together."""
    out: dict[str, list[DataFrame]] = {"scenes": [], "units": [], "warnings": [], "rejects": []}
    for name, parse in formats.items():
        texts = rows.filter(F.col("rejection").isNull() & (F.col("format") == name)).select("doc_id", "text")
        made = parse(texts)
        out["scenes"].append(_shaped(made["scenes"], SCENES))
        out["units"].append(made["units"].select(*parsing.UNIT_COLUMNS))
        out["warnings"].append(_shaped(made["warnings"], WARNINGS))
        if "rejects" in made:
            out["rejects"].append(made["rejects"].select("doc_id", "rejection"))
    kinds = rows.select("doc_id", "rejection")
    return {name: _union(frames) if frames else kinds.limit(0) for name, frames in out.items()}


def import_corpus(payloads: DataFrame, formats: dict[str, Callable] = FORMATS, max_scenes: int = vocab.MAX_SCENES,
                  max_units: int = vocab.MAX_UNITS_PER_SCENE) -> dict[str, DataFrame]:
    """The tables of one import: ``imports`` (a row per payload), ``warnings``, ``scripts``, ``scenes``, ``units``.

    ``payloads``: content, source_name, and doc_id (else made from the name). A payload is
    rejected for, in this order: its size, its bytes, its format, what its parser finds, having
    no scene heading, and its likeness to a screenplay. Warnings keep their scene where
    they have one. Rejected payloads leave no rows in the last three tables.
    """
    if "doc_id" not in payloads.columns:
        payloads = payloads.withColumn("doc_id", F.sha2("source_name", 256))
    docs = durable(received(payloads, formats))
    found = parsed(docs, formats)
    headed = found["scenes"].groupBy("doc_id").agg(F.bool_or(F.coalesce("heading", F.lit("")) != "").alias("_headed"))
    scenes, units, limits, _ = ingest.enforce_limits(durable(found["scenes"]), durable(found["units"]), max_scenes, max_units)
    verdicts = durable(aggregates.likeness(scenes, units))
    weak = verdicts.select("doc_id", F.explode("reasons").alias("_r")).select("doc_id", F.lit("weak_screenplay_signal").alias("code"))
    unsure = docs.filter("confidence < 0.5").select("doc_id", F.lit("low_format_confidence").alias("code"))
    told = _union([found["warnings"], *[_shaped(frame, WARNINGS) for frame in (limits, weak, unsure)]])
    judged = docs.drop("text").join(found["rejects"].withColumnRenamed("rejection", "_parser"), "doc_id", "left").join(
        headed, "doc_id", "left").join(verdicts.drop("reasons"), "doc_id", "left")
    reason = F.coalesce("rejection", "_parser", F.when(~F.coalesce("_headed", F.lit(False)), "no_scenes"),
                        F.when(~F.coalesce("is_screenplay", F.lit(False)), "not_a_screenplay"))
    judged = durable(judged.withColumn("rejection", reason).drop("_parser", "_headed"))
    warnings = durable(told.join(judged.filter("rejection IS NULL").select("doc_id"), "doc_id", "left_semi"))
    outcomes = ingest.outcome(warnings, judged.select(
        "doc_id", F.col("rejection").isNull().alias("is_screenplay"), F.coalesce("needs_review", F.lit(False)).alias("needs_review")))
    imports = durable(judged.select("doc_id", "source_name", "content_hash", "size", "format", "confidence", "title",
                                    "rejection", "score").join(outcomes, "doc_id"))
    tables = ingest.corpus_tables(imports.drop("rejection", "score"), scenes, units)
    return {"imports": imports, "warnings": warnings, **tables}


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Write a snapshot beside the others, then name it in the manifest; returns its name.

    Readers follow the manifest, so a snapshot is seen whole or not at all, and one that
    failed half-way is never listed. The manifest's row counts are those of the written
    files. Of several snapshots the one listed last counts, by the writing driver's clock.
    """
    spark = next(iter(tables.values())).sparkSession
    name = uuid.uuid4().hex
    ingest.write_corpus(tables, f"{folder}/snapshots/{name}")
    moment = time.time_ns()
    schemas = {table: frame.withColumn("bucket", F.lit(0)).schema for table, frame in tables.items()}
    rows = [(moment, name, table, _table(spark, folder, name, table, schema).count(), schema.json())
            for table, schema in schemas.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return name


def _table(spark: SparkSession, folder: str, snapshot: str, table: str, schema: T.StructType) -> DataFrame:
    """A table of a snapshot; one without rows has no files, so the schema is given."""
    return spark.read.schema(schema).parquet(f"{folder}/snapshots/{snapshot}/{table}").drop("bucket")


def published(spark: SparkSession, folder: str, snapshot: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, by default the one listed last."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    if snapshot is None:
        snapshot = manifest.agg(F.max_by("snapshot", F.struct("listed_at", "snapshot"))).first()[0]
    rows = manifest.filter(F.col("snapshot") == snapshot).collect()
    return {row["table"]: _table(spark, folder, snapshot, row["table"], T.StructType.fromJson(json.loads(row["schema"])))
            for row in rows}

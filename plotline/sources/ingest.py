"""Documents in, decoded, typed, limited and written."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline import vocab
from plotline.functions import headings
from plotline.functions.text import split_lines, strip
from plotline.operators import scans

SNIFF = 4096
# Byte-order marks, longest first, with the codec each declares.
BOMS = [("FFFE0000", "utf-32-le"), ("0000FEFF", "utf-32-be"), ("EFBBBF", "utf-8-sig"),
        ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be")]
# The markers only Fountain text carries.
# Each stands beside characters it cannot do without, which are looked for first.
FOUNTAIN_MARKERS = {
    r"(?mdU)^\s*\.[A-Za-z]": ".", r"(?mdU)^\s*@[A-Za-z]": "@", r"(?mdU)^\s*!": "!",
    r"(?mdU)^\s*>.+<\s*$": ">", r"(?s)\[\[.+?\]\]": "[[", r"(?mdU)^\s*={3,}\s*$": "===",
    r"(?mdU)#[\p{L}\p{N}_.\-]+#\s*$": "#", r"(?mdU)^\s*\S.*\^\s*$": "^"}
FOUNTAIN_TITLE = (r"(?imdU)^(?:title|credit|author|authors|source|draft date|contact|notes|"
                  r"copyright|revision)\s*:")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their path; splits are planned by Spark.

    The bytes of a file over the size limit are not read: its content is null, its size stated.
    Spark's scan passes over files without bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = [F.col("path").alias("source_name"), F.col("length").alias("size"), F.col("modificationTime").alias("imported_at")]
    fits = files.filter(F.col("length") <= vocab.MAX_UPLOAD_BYTES).select(*named, "content")
    large = files.filter(F.col("length") > vocab.MAX_UPLOAD_BYTES).select(*named, F.lit(None).cast("binary").alias("content"))
    return fits.unionByName(large)


def identify(payloads: DataFrame) -> DataFrame:
    """Content hash, extension and size of each payload (content, source_name; size if known)."""
    size = F.col("size") if "size" in payloads.columns else F.octet_length("content").cast("long")
    extension = F.lower(F.regexp_extract("source_name", r"\.([^.]*)$", 1))
    return payloads.withColumns({
        "content_hash": F.sha2("content", 256), "extension": extension,
        "size": size,
        "rejection": F.when(size > vocab.MAX_UPLOAD_BYTES, "payload_too_large")})


def declared_codec(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = None
    for mark, codec in BOMS:
        test = head.startswith(mark)
        out = F.when(test, codec) if out is None else out.when(test, codec)
    return out


@F.pandas_udf(T.StringType())
def _decode(content: pd.Series, codec: pd.Series) -> pd.Series:
    """Only rows that are not plain UTF-8 arrive here; the rest are null."""
    def one(data, name):
        if data is None:
            return None
        for attempt in ([name] if name else ["cp1252"]):
            try:
                return codecs.decode(bytes(data), attempt).lstrip("﻿")
            except UnicodeDecodeError:
                pass
        return None
    return pd.Series([one(c, n) for c, n in zip(content, codec, strict=True)], dtype="object")


def decode(payloads: DataFrame) -> DataFrame:
    """Text by byte-order mark, then UTF-8, then Windows-1252, else a rejection."""
    codec = declared_codec(F.col("content"))
    plain = F.when(codec.isNull() | (codec == "utf-8-sig"),
                   F.try_validate_utf8(F.col("content").cast("string")))
    hard = plain.isNull() & (codec.isNull() | (codec != "utf-8-sig"))
    text = F.coalesce(F.ltrim(plain, F.lit("﻿")),
                      _decode(F.when(hard, F.col("content")), codec))
    named = payloads if "rejection" in payloads.columns else payloads.withColumn(
        "rejection", F.lit(None).cast("string"))
    return named.withColumn("text", text).withColumn("rejection", F.coalesce(
        "rejection", F.when(F.col("text").isNull(), "undecodable_text")))


def _text_format(text: Column, extension: Column) -> Column:
    hits = F.lit(0)
    for pattern, sign in FOUNTAIN_MARKERS.items():
        hits = hits + (F.contains(text, F.lit(sign)) & text.rlike(pattern)).cast("int")
    titled = F.left(text, F.lit(2000)).rlike(FOUNTAIN_TITLE)
    lines = F.transform(split_lines(text), strip)
    slugs = F.exists(lines, headings.is_heading)
    acts = F.size(F.filter(lines, lambda x: headings.act_ordinal(x)["matched"]
                           | headings.stage_scene(x)["matched"]))
    cues = F.size(F.filter(lines, lambda x: headings.is_cue(x) | headings.inline_cue(x).isNotNull()))

    def found(name, confidence):
        return F.struct(F.lit(name).alias("format"), F.lit(confidence).alias("confidence"))
    return (F.when((hits >= 2) | (titled & (hits >= 1)), found("fountain", 0.95))
            .when(titled & slugs, found("fountain", 0.8))
            .when((hits == 1) & slugs, found("fountain", 0.6))
            .when(slugs & (extension == "fountain"), found("fountain", 0.6))
            .when(slugs, found("plain_text", 0.7))
            .when((acts >= 3) & (cues >= 5), found("stage_play", 0.75))
            .otherwise(found("plain_text", 0.3)))


def detect(payloads: DataFrame) -> DataFrame:
    """S3: (format, confidence) of each payload from its bytes and text."""
    content, text = F.col("content"), F.col("text")
    latin = F.decode(F.substring(content, 1, SNIFF), "ISO-8859-1")
    boms = F.hex(F.substring(content, 1, 3))
    has_bom = boms.startswith("EFBBBF") | boms.startswith("FFFE") | boms.startswith("FEFF")
    root = r"(?i)<\s*FinalDraft[\s>]"
    bom_text = F.when(has_bom, F.left(text, F.lit(SNIFF)))
    printable = F.char_length(F.regexp_replace(latin, r"[^\t\n\r\x20-\x7e\xa0-\xff]", ""))
    nul = F.contains(latin, F.lit("\x00")) & ~boms.startswith("FFFE") & ~boms.startswith("FEFF")
    binary = ~has_bom & (nul | (printable / F.char_length(latin) < 0.85))

    def found(name, confidence):
        return F.struct(F.lit(name).alias("format"), F.lit(confidence).alias("confidence"))
    empty = ~F.decode(content, "ISO-8859-1").rlike(r"[^\s\x0b]")
    result = (F.when(empty, found("unknown", 0.0))
              .when(latin.startswith("%PDF-"), found("pdf", 1.0))
              .when(F.contains(F.left(latin, F.lit(1024)), F.lit("%PDF-")), found("pdf", 0.8))
              .when(latin.rlike(root) | F.coalesce(bom_text.rlike(root), F.lit(False)),
                    found("fdx", 1.0))
              .when(latin.rlike(r"(?i)^\s*(?:ï»¿)?<\?xml[\s?]"), found("unknown", 0.2))
              .when(binary, found("unknown", 0.0))
              .when(text.isNotNull(), _text_format(text, F.col("extension")))
              .otherwise(found("unknown", 0.0)))
    return payloads.withColumn("_d", result).select(
        *payloads.columns, F.col("_d.format").alias("format"),
        F.col("_d.confidence").alias("confidence"))


def title(document_title: Column, source_name: Column) -> Column:
    """The document's own title, else the file stem, else Untitled."""
    leaf = F.regexp_extract(source_name, r"([^/]*)$", 1)
    stem = strip(F.translate(F.regexp_replace(leaf, r"\.[^.]*$", ""), "-_", "  "))
    return F.coalesce(F.nullif(strip(document_title), F.lit("")), F.nullif(stem, F.lit("")),
                      F.lit("Untitled"))


def fountain_title(text: Column) -> Column:
    """The Title: value of a title page: the key must stand before the first blank line."""
    page = F.regexp_extract(text, r"(?s)^(.*?)(?:\n[ \t\r]*\n|$)", 1)
    return F.nullif(strip(F.regexp_extract(page, r"(?imd)^[ \t]*title\s*:[ \t]*(.*)$", 1)),
                    F.lit(""))


def twins(imports: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Each import of bytes already there, with the newest import before it.

    Imports are ordered by (imported_at, import_id); ``copies`` counts those already
    there, so the first import of some bytes has no row. Bytes uploaded more than
    ``hot_rows`` times are scanned in blocks.
    """
    narrow = imports.select("import_id", "content_hash", "imported_at")
    keys, order = ["content_hash"], [F.col("imported_at"), F.col("import_id")]
    found = scans.Scan(narrow, keys, order, hot_rows).previous({"twin_id": F.col("import_id")}).total("copies", F.lit(1)).done()
    return found.filter("copies > 0").select("import_id", "content_hash", "twin_id", F.col("copies").cast("long"))


def enforce_limits(scenes: DataFrame, units: DataFrame,
                   max_scenes: int = vocab.MAX_SCENES,
                   max_units: int = vocab.MAX_UNITS_PER_SCENE
                   ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scenes, units, warnings, rejects) after the import limits.

    The limits are the import's own rule; every cut is stated as a warning and
    every unit cut off is a row of rejects, with the limit it lies beyond.
    """
    many = (scenes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > max_scenes))
    long = (units.filter(F.col("scene_index") < max_scenes).groupBy("doc_id", "scene_index")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_units))
    warnings = many.select(
        "doc_id", F.lit("scene_limit").alias("code"), F.lit(None).cast("long").alias("scene_index"),
        F.concat("n", F.lit(f" scenes found; only the first {max_scenes} were imported."))
        .alias("message")).unionByName(long.select(
            "doc_id", F.lit("unit_limit").alias("code"), F.col("scene_index").cast("long"),
            F.concat(F.lit("Scene "), "scene_index", F.lit(" has "), "n",
                     F.lit(f" units; only the first {max_units} were imported."))
            .alias("message")))
    beyond = (F.when(F.col("scene_index") >= max_scenes, "scene_limit")
              .when(F.col("sequence_index") >= max_units, "unit_limit"))
    return (scenes.filter(F.col("scene_index") < max_scenes), units.filter(beyond.isNull()), warnings,
            units.withColumn("code", beyond).filter("code IS NOT NULL"))


def outcome(warnings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The outcome of each import from its warning codes and its verdict.

    ``verdicts``: doc_id, is_screenplay, needs_review.
    """
    codes = warnings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or(F.col("code").isin(*vocab.REVIEW_WARNING_CODES)).alias("_review"))
    result = (F.when(~F.col("is_screenplay"), "rejected")
              .when(F.col("needs_review") | F.coalesce("_review", F.lit(False)), "needs_review")
              .when(F.col("_n") > 0, "accepted_with_warnings").otherwise("accepted"))
    return verdicts.join(codes, "doc_id", "left").select("doc_id", result.alias("outcome"))


def stable_id(*parts: str) -> Column:
    """A deterministic id, so that writing the same corpus twice writes the same rows."""
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)


def corpus_tables(outcomes: DataFrame, scenes: DataFrame, units: DataFrame) -> dict[str, DataFrame]:
    """Scripts, scenes and units of the accepted documents, with stable ids."""
    kept = outcomes.filter("outcome <> 'rejected'").select("doc_id")
    scripts = outcomes.filter("outcome <> 'rejected'").withColumn("script_id", stable_id("doc_id"))
    scene_rows = scenes.join(kept, "doc_id", "left_semi").withColumns({
        "script_id": stable_id("doc_id"), "scene_id": stable_id("doc_id", "scene_index")})
    unit_rows = units.join(kept, "doc_id", "left_semi").withColumns({
        "scene_id": stable_id("doc_id", "scene_index"),
        "unit_id": stable_id("doc_id", "scene_index", "sequence_index")})
    return {"scripts": scripts, "scenes": scene_rows, "units": unit_rows}


def write_corpus(tables: dict[str, DataFrame], folder: str, buckets: int = 64) -> None:
    """One Parquet table each, partitioned by a hash bucket of the document.

    Rows are brought together by bucket before the write, so files are few; adaptive
    execution splits the buckets that are too large for one task.
    """
    for name, frame in tables.items():
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
        frame.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{folder}/{name}")

"""Positioned text lines into blocks and units (page, x, y, text in; no codec here)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import headings as H
from plotline.functions.text import strip
from plotline.session import durable
from plotline.sources.parsing import scene_units

# Page geometry in points.
DIALOGUE, PARENTHETICAL, CHARACTER = 40.0, 80.0, 120.0
LINE_TOLERANCE, BLOCK_GAP, COLUMN_SHIFT = 3.0, 18.0, 10.0
MARGIN_NUMBER = (r"(?i)^([0-9]{1,4}[A-Za-z]{0,2})\s+((?:INT|EXT|EST|I/E)\b.*?)"
                 r"(?:\s+\1)?\s*$")


def _segment(last: int):
    return Window.partitionBy("doc_id", "segment").orderBy("block").rowsBetween(
        Window.unboundedPreceding, last)


def rendered_lines(items: DataFrame) -> DataFrame:
    """Text items of one rendered line joined left to right; lines run down the page.

    One page is one group; a page of a document within the size limit is bounded.
    """
    row = F.bround(F.col("y") / LINE_TOLERANCE)
    grouped = items.groupBy("doc_id", "page", row.alias("row")).agg(
        F.min("x").alias("x"), F.max("y").alias("y"),
        F.array_sort(F.collect_list(F.struct("x", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    down = Window.partitionBy("doc_id", "page").orderBy(F.col("row").desc())
    return grouped.withColumn("text", strip(text)).filter("text <> ''").withColumn(
        "pos", F.row_number().over(down) - 1).select("doc_id", "page", "pos", "x", "y", "text")


def block_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block each line belongs to: the rule looks at the block's first line.

    Lines come by document, page and place; a page opens a block. What a document's last
    line left travels on to the next batch.
    """
    doc = page = edge = last = None
    block = -1
    for batch in batches:
        numbers = []
        keys = [batch.column(c).to_pylist() for c in ("doc_id", "page", "solo")]
        places = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("x", "y")]
        for d, p, solo, x, y in zip(*keys, *places, strict=True):
            if d != doc:
                block = -1
            if d != doc or p != page:
                doc, page, edge = d, p, None
            if edge is None or solo or abs(last - y) > BLOCK_GAP or abs(x - edge) > COLUMN_SHIFT:
                block += 1
                edge = x
            if solo:
                edge = None
            last = y
            numbers.append(block)
        kept = [batch.column(c) for c in ("doc_id", "page", "pos", "x", "y", "text")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int64())], names=["doc_id", "page", "pos", "x", "y", "text", "block"])


def looks_like_cue(text: Column) -> Column:
    t = strip(text)
    return (F.char_length(t) <= 38) & ~t.rlike(r"[.!?]$") & H.is_cue(t)


def positioned(rows: DataFrame, ocr: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scenes, units) of positioned lines: doc_id, page, pos, x, y, text."""
    solo = F.col("text").rlike(MARGIN_NUMBER) | H.is_heading(F.col("text"))
    if ocr:
        solo = solo | looks_like_cue(F.col("text"))
    marked = rows.select("doc_id", "page", "pos", "x", "y", "text", solo.alias("solo"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in marked.schema if f.name != "solo"]
    # One pass over sorted partitions: a Python call a page costs far more than its lines.
    lines = marked.repartition("doc_id").sortWithinPartitions("doc_id", "page", "pos").mapInArrow(
        block_numbers, ", ".join([*kinds, "block long"]))
    edge = rows.groupBy("doc_id", (F.bround(F.col("x") / 5.0) * 5.0).alias("edge")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "pos")).alias("at"))
    margin = edge.groupBy("doc_id").agg(F.max_by("edge", F.struct(
        "n", (-F.col("at.page")).alias("p"), (-F.col("at.pos")).alias("q"))).alias("margin"))
    blocks = lines.groupBy("doc_id", "block").agg(
        F.min("x").alias("left"), F.max("y").alias("top"), F.min("y").alias("bottom"),
        F.min("page").alias("page"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", "text"))),
                                 lambda u: u["text"]), " ").alias("raw")).join(margin, "doc_id")
    number = F.nullif(F.regexp_extract("raw", MARGIN_NUMBER, 1), F.lit(""))
    text = F.when(number.isNotNull(), strip(F.regexp_extract("raw", MARGIN_NUMBER, 2))).otherwise(
        strip(F.col("raw")))
    blocks = blocks.withColumn("margin_number", number).withColumn("text", text).filter("text <> ''")
    blocks = durable(_typed(blocks, ocr).select(
        "doc_id", "block", "scene_index", "unit_type", "text", "speaker", "confidence", "margin_number",
        "page", "left", "bottom", "top"))
    bare = H.without_number(F.col("text"))
    split = H.split_heading(bare)
    heading = F.col("unit_type") == "scene_heading"
    scenes = blocks.filter(heading).select(
        "doc_id", "scene_index", bare.alias("heading"),
        F.coalesce(H.scene_number(F.col("text")), "margin_number").alias("number"),
        split["int_ext"].alias("int_ext"), split["time_of_day"].alias("time_of_day"))
    units = blocks.withColumn("text", F.when(heading, bare).otherwise(F.col("text"))).withColumn(
        "sequence_index", F.row_number().over(scene_units().orderBy("block")) - 1)
    return scenes, units.select("doc_id", "scene_index", "sequence_index", "unit_type", "text",
                                "speaker", "confidence", "page", "block", "left", "bottom", "top")


def _typed(blocks: DataFrame, ocr: bool) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("block")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    text, offset = F.col("text"), F.col("left") - F.col("margin")
    heading = H.is_heading(text)
    cut = ~heading & H.is_transition(text)
    bracket = text.startswith("(") & text.endswith(")")
    cue = H.is_cue(text)
    free = ~heading & ~cut & ~bracket
    if ocr:
        named = free & looks_like_cue(text)
        ends = free & ~named & H.is_shot(text)
        opens_speech = bracket | named
    else:
        named = free & (offset >= CHARACTER) & cue
        hung = free & ~named & (offset >= PARENTHETICAL) & text.startswith("(")
        inner = free & ~named & ~hung & (offset >= DIALOGUE)
        outer = free & ~named & ~hung & ~inner
        late_cue = outer & ~H.is_shot(text) & (text == F.upper(text)) & cue
        opens_speech = bracket | named | hung
        # At the action margin only capitals inside speech keep it open.
        ends = outer & ~late_cue
    closes = heading | cut | ends
    blocks = blocks.withColumns({"_h": heading, "_cut": cut, "_open": opens_speech})
    blocks = blocks.withColumn("segment", F.sum(closes.cast("int")).over(so_far))
    blocks = blocks.withColumn("in_speech", F.coalesce(F.max("_open").over(
        _segment(-1)), F.lit(False)))
    speech = F.col("in_speech")

    def unit(kind, confidence):
        return F.struct(F.lit(kind).alias("t"), F.lit(confidence).alias("c"))
    first = (F.when(F.col("_h"), unit("scene_heading", 1.0)).when(F.col("_cut"), unit("transition", 0.95))
             .when(bracket, unit("parenthetical", 0.9)))
    if ocr:
        kind = (first.when(named, unit("character", 0.7)).when(H.is_shot(text), unit("shot", 0.8))
                .when(speech, unit("dialogue", 0.7)).otherwise(unit("action", 0.7)))
    else:
        kind = (first.when(named, unit("character", 0.95)).when(hung, unit("parenthetical", 0.9))
                .when(inner & speech, unit("dialogue", 0.9)).when(inner, unit("action", 0.45))
                .when(H.is_shot(text), unit("shot", 0.8))
                .when(speech & late_cue, unit("character", 0.5)).otherwise(unit("action", 0.9)))
    blocks = blocks.withColumn("_k", kind).withColumn("unit_type", F.col("_k.t")).withColumn(
        "confidence", F.col("_k.c"))
    headings = F.sum(F.col("_h").cast("int")).over(so_far)
    blocks = blocks.withColumn("_n", headings)
    blocks = blocks.withColumn("scene_index", F.col("_n") - F.when(
        F.min("_n").over(Window.partitionBy("doc_id")) == 0, 0).otherwise(1))
    name = F.when(F.col("unit_type") == "character", F.coalesce(H.cue(text)["name"], text))
    spoken = F.col("unit_type").isin("character", "dialogue", "parenthetical")
    return blocks.withColumn("_name", name).withColumn("speaker", F.when(spoken, F.last(
        "_name", ignorenulls=True).over(_segment(0))))

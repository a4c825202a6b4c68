"""Fountain and plain text as window jobs over lines.

Both grammars share one shape. A blank line, a heading or a transition opens a
segment. Inside a segment the first cue (or bracketed line) starts speech, and
everything after it is speech, so the state a line parser would carry is a
running maximum over the segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import headings as H
from plotline.functions.text import strip
from plotline.session import durable
from plotline.sources.lines import doc_before, doc_so_far, lines, whole_doc

# Fountain's block marks and title-page line.
BONEYARD = r"(?s)/\*.*?\*/"
NOTE = r"(?s)\[\[.*?\]\]"
TITLE_KEY = r"^[A-Za-z][A-Za-z ]*?\s*:\s*.*$"
PAGE_BREAK = r"(?U)^\s*={3,}\s*$"
SYNOPSIS = r"(?U)^\s*=(?!=)"
SECTION = r"(?U)^\s*#{1,6}\s+\S"
CENTRED = r"(?U)^\s*>\s*(.+?)\s*<\s*$"

UNIT_COLUMNS = ["doc_id", "scene_index", "sequence_index", "unit_type", "text", "speaker",
                "confidence", "method", "start", "end"]


def segment_before():
    return Window.partitionBy("doc_id", "segment").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, -1)


def segment_so_far():
    return Window.partitionBy("doc_id", "segment").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0)


def scene_units():
    return Window.partitionBy("doc_id", "scene_index")


def blanked(text: Column, pattern: str) -> Column:
    """Each match replaced by spaces of equal length; line breaks stay."""
    pieces = F.split(text, pattern)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    spaces = F.transform(found, lambda m: F.regexp_replace(m, r"[^\n]", " "))
    return F.array_join(F.zip_with(pieces, spaces, lambda p, s: F.concat(
        F.coalesce(p, F.lit("")), F.coalesce(s, F.lit("")))), "")


def note_rows(texts: DataFrame) -> DataFrame:
    """doc_id, start, end, body of every note that says something."""
    pieces = F.split("text", NOTE)
    found = F.regexp_extract_all("text", F.lit(f"({NOTE})"), F.lit(1))
    rows = texts.filter(F.contains("text", F.lit("[["))).select("doc_id", F.posexplode(
        F.arrays_zip(pieces.alias("piece"), found.alias("note"))).alias("pos", "z"))
    lead = F.char_length("z.piece") + F.coalesce(F.char_length("z.note"), F.lit(0))
    start = F.coalesce(F.sum(lead).over(doc_before()), F.lit(0)) + F.char_length("z.piece")
    body = strip(F.btrim("z.note", F.lit("[]")))
    return (rows.withColumn("start", start).filter("z.note IS NOT NULL")
            .select("doc_id", "start", (F.col("start") + F.char_length("z.note")).alias("end"),
                    body.alias("body")).filter("body <> ''"))


def body_lines(rows: DataFrame) -> DataFrame:
    """Lines after the title page: leading ``Key: value`` lines up to a blank line."""
    blank = F.col("stripped") == ""
    is_break = F.col("line").rlike(PAGE_BREAK)
    is_key = F.col("stripped").rlike(TITLE_KEY) & ~H.is_heading(F.col("stripped")) & ~blank
    seen = F.coalesce(F.max(is_key).over(doc_before()), F.lit(False))
    rows = rows.withColumn("_key", is_key).withColumn("_seen", seen)
    indented = F.col("line").startswith(" ") | F.col("line").startswith("\t")
    after = F.col("start") + F.char_length("raw")
    stop = (F.when(is_break, after).when(blank, F.when(F.col("_seen"), after))
            .when(F.col("_key"), F.lit(None).cast("long"))
            .when(~(F.col("_seen") & indented), F.when(F.col("_seen"), F.col("start")).otherwise(0)))
    first = F.min(F.when(stop.isNotNull(), F.struct(F.col("pos"), stop.alias("at")))).over(whole_doc())
    any_key = F.max("_key").over(whole_doc())
    length = F.sum(F.char_length("raw")).over(whole_doc())
    begin = F.coalesce(first["at"], F.when(any_key, length).otherwise(0))
    return rows.withColumn("_begin", begin).filter(F.col("start") >= F.col("_begin")).drop(
        "_begin", "_key", "_seen")


def _number_scenes(rows: DataFrame, heading: Column, skipped: Column) -> DataFrame:
    """Scene index per line; text before the first heading is a scene of its own."""
    count = F.sum(F.when(heading, 1).otherwise(0)).over(doc_so_far())
    rows = rows.withColumn("_h", count)
    early = F.max((F.col("_h") == 0) & ~skipped & (F.col("stripped") != "")).over(whole_doc())
    return rows.withColumn("early", early).withColumn(
        "scene_index", F.col("_h") - F.when(F.col("early"), 0).otherwise(1)).drop("_h")


def _scenes(rows: DataFrame) -> DataFrame:
    """Every scene with what its heading says, unheaded openings included."""
    parts = H.split_heading(F.col("text"))
    headed = rows.filter("is_heading").select(
        "doc_id", "scene_index", F.col("text").alias("heading"), "number",
        parts["int_ext"].alias("int_ext"), parts["time_of_day"].alias("time_of_day"), "start")
    opening = rows.filter("early").groupBy("doc_id").agg(F.lit(0).cast("long").alias("scene_index"),
                                                         F.min("start").alias("start")).select(
        "doc_id", "scene_index", F.lit("").alias("heading"), F.lit(None).cast("string").alias("number"),
        F.lit(None).cast("string").alias("int_ext"),
        F.lit(None).cast("string").alias("time_of_day"), "start")
    return headed.unionByName(opening)


def fountain(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scenes, units, warnings) of a Fountain corpus (doc_id, text)."""
    cleared = texts.withColumn("text", blanked(F.col("text"), BONEYARD))
    notes = note_rows(cleared)
    rows = body_lines(lines(cleared.withColumn("text", blanked(F.col("text"), NOTE))))
    s = F.col("stripped")
    skip = (F.col("line").rlike(PAGE_BREAK) | F.col("line").rlike(SYNOPSIS)
            | F.col("line").rlike(SECTION))
    rows = rows.filter(~skip | (s == ""))
    forced_heading = s.startswith(".") & ~s.startswith("..")
    heading = forced_heading | H.is_heading(s)
    forced_cut = s.startswith(">") & ~s.rlike(CENTRED)
    transition = ~heading & (forced_cut | H.is_transition(s))
    at = s.startswith("@")
    candidate = F.when(at, strip(F.substr(s, F.lit(2)))).otherwise(s)
    rows = rows.withColumns({
        "is_heading": heading, "is_transition": transition, "at": at, "candidate": candidate,
        "forced_heading": forced_heading, "forced_cut": forced_cut})
    rows = rows.withColumn("parsed", H.cue(F.col("candidate")))
    opens = (s == "") | F.col("is_heading") | F.col("is_transition")
    rows = rows.withColumn("segment", F.sum(F.when(opens, 1).otherwise(0)).over(doc_so_far()))
    rows = _number_scenes(rows, F.col("is_heading"), F.lit(False)).filter(s != "")
    free = ~F.col("is_heading") & ~F.col("is_transition")
    starter = free & (F.col("at") | (F.col("parsed").isNotNull() & ~H.is_shot(F.col("candidate"))))
    rows = rows.withColumn("starter", starter)
    rows = rows.withColumn("in_speech", F.coalesce(F.max("starter").over(segment_before()),
                                                   F.lit(False)))
    is_cue = free & (F.col("at") | (~F.col("in_speech") & F.col("starter")))
    bracket = s.startswith("(") & s.endswith(")")
    forced_action = s.startswith("!")
    centred = F.regexp_extract(s, CENTRED, 1)
    plain = F.when(centred != "", centred).when(
        forced_action, strip(F.substr(s, F.lit(2)))).otherwise(s)
    kind = (F.when(F.col("is_heading"), "scene_heading").when(F.col("is_transition"), "transition")
            .when(is_cue, "character")
            .when(F.col("in_speech"), F.when(bracket, "parenthetical").otherwise("dialogue"))
            .when(~forced_action & H.is_shot(plain), "shot").otherwise("action"))
    unforced = F.when(F.col("forced_heading"), strip(F.substr(s, F.lit(2)))).otherwise(s)
    rows = rows.withColumn("unit_type", kind).withColumn("number", H.scene_number(unforced))
    text = (F.when(F.col("is_heading"), H.without_number(unforced))
            .when(F.col("is_transition"), F.when(F.col("forced_cut"), strip(F.substr(s, F.lit(2))))
                  .otherwise(s))
            .when(F.col("unit_type") == "character", strip(F.rtrim("candidate", F.lit("^ "))))
            .when(F.col("in_speech"), s).otherwise(plain))
    name = F.when(F.col("unit_type") == "character", F.coalesce("parsed.name", "candidate"))
    spoken = F.col("unit_type").isin("character", "dialogue", "parenthetical")
    long_end = F.col("unit_type").isin("scene_heading", "action", "shot")
    rows = rows.withColumns({
        "text": text, "_name": name,
        "confidence": F.when(F.col("is_heading"), F.when(F.col("forced_heading"), 0.9).otherwise(1.0))
        .when(F.col("unit_type") == "character", F.when(F.col("at"), 1.0).otherwise(0.9))
        .otherwise(1.0),
        "end": F.col("start") + F.when(long_end, F.char_length("line")).otherwise(F.char_length(s))})
    rows = rows.withColumn("speaker", F.when(spoken, F.last("_name", ignorenulls=True)
                                             .over(segment_so_far())))
    rows = durable(rows.select(
        "doc_id", "pos", "scene_index", "start", "end", "unit_type", "text", "speaker", "confidence",
        "number", "is_heading", "early", F.coalesce("parsed.dual", F.lit(False)).alias("dual")))
    scenes = _scenes(rows)
    noted = _attach_notes(scenes, notes)
    found = rows.select("doc_id", "scene_index", F.lit(0).alias("_late"), "start", "end", "unit_type",
                        "text", "speaker", "confidence").unionByName(noted)
    order = scene_units().orderBy("_late", "start")
    units = found.withColumn("sequence_index", F.row_number().over(order) - 1).withColumn(
        "method", F.lit("fountain")).select(*UNIT_COLUMNS)
    dual = rows.filter(F.col("dual") & (F.col("unit_type") == "character")).select(
        "doc_id", F.lit("dual_dialogue").alias("code"), F.col("scene_index").cast("long"))
    cut = texts.filter(F.col("text").rlike(BONEYARD)).select(
        "doc_id", F.lit("boneyard_discarded").alias("code"), F.lit(None).cast("long")
        .alias("scene_index"))
    return scenes, units, dual.unionByName(cut).unionByName(_early_warning(scenes))


def _early_warning(scenes: DataFrame) -> DataFrame:
    return scenes.filter("heading = ''").select(
        "doc_id", F.lit("content_before_first_scene").alias("code"),
        F.lit(0).cast("long").alias("scene_index"))


def _attach_notes(scenes: DataFrame, notes: DataFrame) -> DataFrame:
    """A note joins the last scene that starts at or before it, else the first."""
    events = scenes.select("doc_id", "start", F.lit(0).alias("_side"), "scene_index",
                           F.lit(None).cast("long").alias("end"),
                           F.lit(None).cast("string").alias("body")).unionByName(
        notes.select("doc_id", "start", F.lit(1).alias("_side"),
                     F.lit(None).cast("long").alias("scene_index"), F.col("end").cast("long"), "body"))
    window = Window.partitionBy("doc_id").orderBy("start", "_side").rowsBetween(
        Window.unboundedPreceding, 0)
    placed = events.withColumn("_at", F.coalesce(
        F.last("scene_index", ignorenulls=True).over(window), F.lit(0)))
    return placed.filter("_side = 1").select(
        "doc_id", F.col("_at").cast("long").alias("scene_index"), F.lit(1).alias("_late"), "start", "end",
        F.lit("note").alias("unit_type"), F.col("body").alias("text"),
        F.lit(None).cast("string").alias("speaker"), F.lit(1.0).alias("confidence"))


def expanded(line: Column) -> Column:
    """Tabs to the next multiple of eight columns, for the leading run only."""
    lead = F.regexp_extract(line, r"^[ \t]*", 0)
    width = F.aggregate(F.filter(F.split(lead, ""), lambda ch: ch != ""), F.lit(0), lambda n, ch:
                        F.when(ch == "\t", (F.floor(n / 8) + 1).cast("int") * 8).otherwise(n + 1))
    return width


def plain(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scenes, units, warnings) of a plain-text corpus, typed by indentation.

    The indent is the raw length less the length of the expanded, left-stripped
    line, so a tab in the margin does not add the columns it spans. That is how
    the margins are defined, and tests hold it.
    """
    rows = lines(texts)
    s = F.col("stripped")
    body = F.ltrim("line", F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"))
    inner_tabs = F.contains(body, F.lit("\t"))
    # Tabs after the margin still expand, and that length is taken off as well.
    grown = F.when(inner_tabs, _expanded_length(F.col("line"), body)).otherwise(F.char_length(body))
    rows = rows.withColumn("indent", F.char_length("line") - grown)
    shown = F.when(s != "", F.col("indent"))
    rows = rows.withColumn("margin", F.min(shown).over(whole_doc()))
    deep = F.sum(F.when(shown > F.col("margin") + 2, 1).otherwise(0)).over(whole_doc())
    rows = rows.withColumn("flat", deep < 4)
    heading = H.is_heading(s)
    transition = ~heading & H.is_transition(s)
    rows = rows.withColumns({"is_heading": heading, "is_transition": transition,
                             "parsed": H.cue(s)})
    opens = (s == "") | F.col("is_heading") | F.col("is_transition")
    rows = rows.withColumn("segment", F.sum(F.when(opens, 1).otherwise(0)).over(doc_so_far()))
    rows = _number_scenes(rows, F.col("is_heading"), F.lit(False)).filter(s != "")
    offset = F.col("indent") - F.col("margin")
    bracket = s.startswith("(") & s.endswith(")")
    cue = F.col("parsed").isNotNull()
    deep_cue = ~F.col("flat") & (offset >= 18) & cue
    shallow = F.col("flat") | (offset < 6)
    free_cue = shallow & cue & (F.char_length(s) <= 40)
    free = ~F.col("is_heading") & ~F.col("is_transition")
    starter = free & (bracket | deep_cue | (free_cue & ~H.is_shot(s)))
    rows = rows.withColumn("starter", starter)
    rows = rows.withColumn("in_speech", F.coalesce(F.max("starter").over(segment_before()),
                                                   F.lit(False)))
    speech = F.col("in_speech")
    kind = (F.when(F.col("is_heading"), "scene_heading").when(F.col("is_transition"), "transition")
            .when(bracket, "parenthetical").when(deep_cue, "character")
            .when(~shallow, F.when(speech, "dialogue").otherwise("action"))
            .when(~speech & free_cue, F.when(H.is_shot(s), "shot").otherwise("character"))
            .when(speech, "dialogue").when(H.is_shot(s), "shot").otherwise("action"))
    rows = rows.withColumn("unit_type", kind).withColumn("number", H.scene_number(s))
    name = F.when(F.col("unit_type") == "character", F.coalesce("parsed.name", "stripped"))
    spoken = F.col("unit_type").isin("character", "dialogue", "parenthetical")
    rows = rows.withColumns({
        "_name": name, "text": F.when(F.col("is_heading"), H.without_number(s)).otherwise(s),
        "confidence": F.when(F.col("flat"), 0.6).otherwise(0.9),
        "end": F.col("start") + F.char_length("raw")})
    rows = rows.withColumn("speaker", F.when(spoken, F.last("_name", ignorenulls=True)
                                             .over(segment_so_far())))
    rows = durable(rows.select(
        "doc_id", "pos", "scene_index", "start", "end", "unit_type", "text", "speaker", "confidence",
        "number", "is_heading", "early", "flat"))
    scenes = _scenes(rows)
    order = scene_units().orderBy("pos")
    units = rows.withColumn("sequence_index", F.row_number().over(order) - 1).withColumn(
        "method", F.lit("rule")).select(*UNIT_COLUMNS)
    flat = rows.filter("flat").select("doc_id").distinct().select(
        "doc_id", F.lit("no_indentation").alias("code"), F.lit(None).cast("long").alias("scene_index"))
    return scenes, units, flat.unionByName(_early_warning(scenes))


def _expanded_length(line: Column, body: Column) -> Column:
    """Length of the line after its margin once every tab is expanded."""
    start = expanded(line)
    chars = F.filter(F.split(body, ""), lambda ch: ch != "")
    end = F.aggregate(chars, start, lambda n, ch: F.when(
        ch == "\t", (F.floor(n / 8) + 1).cast("int") * 8).otherwise(n + 1))
    return end - start



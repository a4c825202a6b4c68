"""Stage plays. Carried state is windows; two rules need running state.

The contents block, the cast list, the open bracket and the act in force are
"last event seen" windows. The speech state of a line depends on the state the
line before it reached, and a French scene on the length of the part so far:
those two are small grouped functions over already typed rows of one document,
which S1 bounds at 8 MiB.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import headings as H
from plotline.functions.text import strip
from plotline.session import durable
from plotline.sources.lines import doc_before, doc_so_far, lines, whole_doc
from plotline.sources.parsing import UNIT_COLUMNS, scene_units

# The marks that bound and divide a printed play.
LICENCE_START = r"(?i)\*\*\*\s*START OF TH(?:E|IS) PROJECT GUTENBERG.*?\*\*\*"
LICENCE_END = r"(?i)\*\*\*\s*END OF TH(?:E|IS) PROJECT GUTENBERG.*?\*\*\*"
CONTENTS = r"(?i)^\s*contents\.?\s*$"
CAST_LIST = (r"(?i)^\s*(?:the\s+)?(?:dramatis\s+person(?:ae|æ|e)?|persons?\s+represented"
             r"|characters?(?:\s+in\s+the\s+play)?|the\s+persons(?:\s+of\s+the\s+play)?)\s*[.:]?\s*$")
END_MARK = r"(?i)^_?\[?(?:THE END|FINIS|CURTAIN)\.?\]?_?$"
ENTRANCE = r"(?i)^[_\[\s]*(?:Enter|Re-enter|Re-enters|Exeunt|Exit)\b"
MAX_CUE = 40
SETTING_LINES = 5
SPLIT_FROM = 60
PART_FROM = 8

# What a line asks of the speech state, and the states (numbers travel faster).
BLANK, DIRECTION, BRACKET, INLINE, OPEN, CUE, PLAIN, RESET = range(8)
NONE, ACTION, CHARACTER, DIALOGUE, PARENTHETICAL, HEADING = range(6)
_NAMES = ["none", "action", "character", "dialogue", "parenthetical", "scene_heading"]


def _scene_lines(last: int):
    return Window.partitionBy("doc_id", "scene_no").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, last)


def speech_states(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds to the lines of one document the type each takes and the type before it.

    A blank line ends speech unless a cue is still waiting for it.
    """
    rows = rows.sort_values("pos")
    fixed = {DIRECTION: ACTION, BRACKET: PARENTHETICAL, INLINE: DIALOGUE}
    state, kinds, befores = NONE, [], []
    for ask in rows["ask"]:
        befores.append(state)
        if ask == RESET:
            state = NONE
        elif ask == BLANK:
            state = CHARACTER if state == CHARACTER else NONE
        elif ask in fixed:
            state = fixed[ask]
        elif ask == OPEN:
            state = DIALOGUE if state == DIALOGUE else ACTION
        elif state in (CHARACTER, DIALOGUE, PARENTHETICAL):
            state = DIALOGUE
        else:
            state = CHARACTER if ask == CUE else ACTION
        kinds.append(state)
    return rows.assign(state=kinds, before=befores)


def french_parts(rows: pd.DataFrame) -> pd.DataFrame:
    """The part of an undivided act each unit falls in (1, 2, ...).

    A part opens at an entrance or exit once the one before it has eight units;
    a short last part joins its predecessor.
    """
    rows = rows.sort_values("sequence_index")
    part, size, parts = 1, 0, []
    for opens in rows["entrance"]:
        if opens and size >= PART_FROM:
            part, size = part + 1, 0
        size += 1
        parts.append(part)
    if part > 1 and size < PART_FROM:
        parts[-size:] = [part - 1] * size
    return pd.DataFrame({"doc_id": rows["doc_id"], "scene_index": rows["scene_index"],
                         "sequence_index": rows["sequence_index"], "part": parts})


def _last_event(value: Column) -> Column:
    return F.coalesce(F.last(value, ignorenulls=True).over(doc_so_far()), F.lit(False))


def _front_matter(texts: DataFrame) -> DataFrame:
    """Lines inside the licence, typed as far as no running state is needed."""
    rows = lines(texts)
    s = F.col("stripped")
    begin = F.max(F.when(s.rlike(LICENCE_START), F.col("pos"))).over(whole_doc())
    end = F.min(F.when(s.rlike(LICENCE_END), F.col("pos"))).over(whole_doc())
    rows = rows.withColumn("_b", begin).withColumn("_e", end).filter(
        (F.col("pos") > F.coalesce("_b", F.lit(-1)))
        & (F.col("pos") < F.coalesce("_e", F.lit(1 << 40))))
    blank = s == ""
    rows = rows.withColumns({"act": H.act_ordinal(s), "sc": H.stage_scene(s),
                             "is_cue": H.is_cue(s), "inline": H.inline_cue(s)})
    listed = F.col("act.matched") | F.col("sc.matched") | (
        (F.char_length(s) <= MAX_CUE) & (s == F.upper(s)) & F.col("is_cue"))
    contents = s.rlike(CONTENTS)
    rows = rows.withColumn("in_contents", _last_event(
        F.when(contents, True).when(~blank & ~listed, False)))
    live = ~blank & ~F.col("in_contents")
    rows = rows.withColumns({"is_act": live & F.col("act.matched"),
                             "is_scene": live & ~F.col("act.matched") & F.col("sc.matched")})
    divides = F.col("is_act") | F.col("is_scene")
    cast = live & ~divides & s.rlike(CAST_LIST)
    rows = rows.withColumn("in_cast", _last_event(F.when(cast, True).when(divides, False)))
    rows = rows.withColumn("started", F.coalesce(F.max(divides).over(doc_so_far()), F.lit(False)))
    return rows.withColumn("is_body", live & ~divides & ~F.col("in_cast") & F.col("started"))


def _open_brackets(rows: DataFrame) -> DataFrame:
    """Whether a line continues a bracket opened above it.

    Each line maps open/closed to open/closed. A line either fixes the state,
    keeps it, or swaps it, so the state is the last fixed value with the swaps
    since then applied: two windows and no loop.
    """
    s = F.col("stripped")
    opener = F.regexp_count(s, F.lit(r"\[")) > F.regexp_count(s, F.lit(r"\]"))
    closes = F.contains(s, F.lit("]"))
    fixed = (F.when(s == "", 0).when(~F.col("is_body"), F.lit(None).cast("int"))
             .when(opener & ~closes, 1).when(~opener & closes, 0))
    swap = F.col("is_body") & opener & closes
    rows = rows.withColumn("_swaps", F.sum(F.when(swap, 1).otherwise(0)).over(doc_so_far()))
    rows = rows.withColumn("_fix", F.when(fixed.isNotNull(), F.struct(
        fixed.alias("v"), F.col("_swaps").alias("n"))))
    last = F.last("_fix", ignorenulls=True).over(doc_before())
    swaps_before = F.coalesce(F.lag("_swaps").over(
        Window.partitionBy("doc_id").orderBy("pos")), F.lit(0))
    state = (F.coalesce(last["v"], F.lit(0)) + swaps_before - F.coalesce(last["n"], F.lit(0))) % 2
    return rows.withColumn("continues", F.col("is_body") & (state == 1)).drop("_swaps", "_fix")


def stage_play(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scenes, units, warnings) of a corpus of plays (doc_id, text)."""
    rows = _open_brackets(_front_matter(texts))
    s = F.col("stripped")
    ends = F.col("is_body") & ~F.col("continues") & s.rlike(END_MARK)
    rows = rows.withColumn("_end", F.min(F.when(ends, F.col("pos"))).over(whole_doc())).filter(
        F.col("_end").isNull() | (F.col("pos") < F.col("_end")))
    mark = F.when(F.col("is_act"), F.struct(F.lit("act").alias("kind"), "pos",
                                            F.col("act.ordinal").alias("number")))
    rows = rows.withColumn("_act", mark)
    rows = rows.withColumn("act_no", F.last("_act", ignorenulls=True).over(doc_so_far())["number"])
    divider = F.when(F.col("is_act"), F.struct("pos", F.lit(True).alias("is_act"))).when(
        F.col("is_scene"), F.struct("pos", F.lit(False).alias("is_act")))
    rows = rows.withColumn("_div", F.last(divider, ignorenulls=True).over(doc_so_far()))
    under = Window.partitionBy("doc_id", "_div").orderBy("pos")
    nth = F.sum(F.col("is_body").cast("int")).over(under)
    # A scene opens at its heading, or at the first line under an act that has none.
    opens = F.col("is_scene") | (F.col("is_body") & F.col("_div.is_act") & (nth == 1))
    rows = rows.withColumn("opens", opens)
    rows = rows.withColumn("scene_no", F.sum(F.col("opens").cast("int")).over(doc_so_far()))
    inner = strip(F.btrim(s, F.lit("_")))
    direction = (inner.startswith("[") & F.rtrim(inner, F.lit("._ ")).endswith("]")) | s.rlike(
        H.STAGE_DIRECTION)
    ask = (F.when(s == "", BLANK).when(F.col("is_act") | F.col("is_scene"), RESET)
           .when(~F.col("is_body"), F.lit(None).cast("int"))
           .when(F.col("continues"), OPEN).when(F.col("inline").isNotNull(), INLINE)
           .when(direction, DIRECTION).when(s.startswith("(") & s.endswith(")"), BRACKET)
           .when(F.col("is_cue") & (F.char_length(s) <= MAX_CUE), CUE).otherwise(PLAIN))
    rows = rows.withColumn("ask", ask).filter(F.col("ask").isNotNull())
    kept = rows.select(
        "doc_id", "pos", "stripped", "start", F.char_length("raw").alias("width"), "is_scene", "is_body",
        "continues", "opens", "scene_no", "act_no", F.col("sc.ordinal").alias("scene_ordinal"),
        F.col("sc.setting").alias("setting"), F.col("inline.name").alias("inline_name"),
        F.col("inline.speech").alias("inline_speech"), "ask")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    typed = kept.groupBy("doc_id").applyInPandas(speech_states, f"{shape}, state int, before int")
    return _assemble(durable(typed.filter("is_body OR is_scene")))


def _assemble(body: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = F.col("stripped")
    headed = F.max(F.when(F.col("is_scene"), F.col("setting") != "")).over(
        Window.partitionBy("doc_id", "scene_no"))
    candidate = (F.col("is_body") & ~F.col("continues") & F.col("inline_name").isNull()
                 & (F.col("state") == ACTION) & ~F.coalesce(headed, F.lit(False)))
    named = F.col("is_body") & ~F.col("continues") & (
        F.col("inline_name").isNotNull() | (F.col("state") == CHARACTER))
    body = body.withColumn("_cand", candidate).withColumn("_named", named)
    before = F.coalesce(F.sum(F.col("_cand").cast("int")).over(_scene_lines(-1)), F.lit(0))
    full = F.coalesce(F.max(F.col("_cand") & s.rlike("[.!?]")).over(_scene_lines(-1)), F.lit(False))
    spoke = F.coalesce(F.max("_named").over(_scene_lines(-1)), F.lit(False))
    body = body.withColumn("_set", F.col("_cand") & (before < SETTING_LINES) & ~full & ~spoke)
    body = body.withColumn("_nth", before)
    kinds = F.array(*[F.lit(n) for n in _NAMES])
    first_setting = F.col("_set") & (F.col("_nth") == 0)
    kind = (F.when(F.col("is_scene"), "scene_heading").when(first_setting, "scene_heading")
            .otherwise(F.element_at(kinds, F.col("state") + 1)))
    # A scene heading line shows only when it states a setting.
    shown = body.filter("is_body OR setting <> ''").withColumn("kind", kind)
    cue = H.cue(s)
    name = (F.when(F.col("inline_name").isNotNull() & ~F.col("continues"), F.col("inline_name"))
            .when(F.col("kind") == "character", F.coalesce(cue["name"], s))
            .when(F.col("kind").isin("action", "scene_heading"), F.lit("")))
    shown = shown.withColumn("_name", F.when(F.col("is_scene"), F.lit("")).otherwise(name))
    spoken = F.col("kind").isin("character", "dialogue", "parenthetical")
    speaker = F.nullif(F.last("_name", ignorenulls=True).over(_scene_lines(0)), F.lit(""))
    shown = shown.withColumn("speaker", F.when(spoken, speaker))
    inline = F.col("inline_name").isNotNull() & ~F.col("continues") & F.col("is_body")
    parts = F.when(inline, F.array(
        F.struct(F.lit("character").alias("unit_type"), F.col("inline_name").alias("text")),
        F.struct(F.lit("dialogue").alias("unit_type"), F.col("inline_speech").alias("text")))
    ).otherwise(F.array(F.struct(F.col("kind").alias("unit_type"), s.alias("text"))))
    shown = shown.select("doc_id", "scene_no", "pos", "start", "width", "speaker", "before", "_set",
                         F.posexplode(parts).alias("half", "u")).select(
        "*", "u.unit_type", "u.text").drop("u")
    # Hard-wrapped speech and direction lines join while nothing else intervenes.
    inside = Window.partitionBy("doc_id", "scene_no").orderBy("pos", "half")
    wraps = F.col("unit_type").isin("dialogue", "action")
    seen_type = F.when(F.col("before") == ACTION, "action").when(
        F.col("before") == DIALOGUE, "dialogue")
    follows = (wraps & (F.col("half") == 0) & (seen_type == F.col("unit_type"))
               & (F.lag("unit_type").over(inside) == F.col("unit_type"))
               & F.lag("speaker").over(inside).eqNullSafe(F.col("speaker")))
    runs = shown.withColumn("run", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy("doc_id", "scene_no", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("width")).alias("end"),
        F.first("unit_type").alias("unit_type"), F.first("speaker").alias("speaker"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))),
                                 lambda x: x["text"]), " ").alias("text"))
    return _scenes(body, durable(joined))


def _scenes(body: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    opened = body.filter("opens").select(
        "doc_id", "scene_no", "act_no", F.when(F.col("is_scene"), F.col("scene_ordinal")).alias("number_in"),
        F.when(F.col("is_scene"), F.nullif("setting", F.lit(""))).alias("setting"))
    told = body.filter("_set").groupBy("doc_id", "scene_no").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "stripped"))), lambda x: x["stripped"]), " ")
        .alias("told"))
    act, inner = F.col("act_no"), F.col("number_in")
    label = (F.when(act.isNotNull() & inner.isNotNull(),
                    F.concat(F.lit("Act "), act, F.lit(", Scene "), inner))
             .when(inner.isNotNull(), F.concat(F.lit("Scene "), inner))
             .when(act.isNotNull(), F.concat(F.lit("Act "), act)).otherwise("Opening"))
    place = H.location_of(F.coalesce("setting", "told"))
    filled = joined.filter("unit_type <> 'scene_heading'").select("doc_id", "scene_no").distinct()
    scenes = opened.join(told, ["doc_id", "scene_no"], "left").withColumns({
        "number": F.nullif(F.concat_ws(".", act.cast("string"), inner.cast("string")), F.lit("")),
        "heading": F.coalesce(F.nullif(place, F.lit("")), label)})
    dropped = scenes.join(filled, ["doc_id", "scene_no"], "left_anti").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"))
    kept = scenes.join(filled, ["doc_id", "scene_no"], "left_semi")
    units = joined.join(kept.select("doc_id", "scene_no", "number"), ["doc_id", "scene_no"])
    in_scene = Window.partitionBy("doc_id", "scene_no")
    units = units.withColumn("sequence_index", F.row_number().over(in_scene.orderBy("run")) - 1)
    units = units.withColumn("_n", F.count(F.lit(1)).over(in_scene))
    whole = F.col("number").isNotNull() & ~F.contains("number", F.lit(".")) & (
        F.col("_n") >= SPLIT_FROM)
    long = units.filter(whole).select(
        "doc_id", F.col("scene_no").alias("scene_index"), F.col("sequence_index"),
        ((F.col("unit_type") == "action") & F.col("text").rlike(ENTRANCE)).alias("entrance"))
    key = units.schema["doc_id"].dataType.simpleString()
    cut = long.groupBy("doc_id", "scene_index").applyInPandas(
        french_parts, f"doc_id {key}, scene_index long, sequence_index int, part int"
    ).withColumnRenamed("scene_index", "scene_no")
    units = units.join(cut, ["doc_id", "scene_no", "sequence_index"], "left").withColumn(
        "part", F.coalesce("part", F.lit(1)))
    units = durable(units.drop("_n", "number"))
    sized = units.groupBy("doc_id", "scene_no").agg(F.max("part").alias("parts"))
    pieces = kept.join(sized, ["doc_id", "scene_no"]).withColumn(
        "part", F.explode(F.sequence(F.lit(1), "parts"))).withColumn(
        "number", F.when(F.col("parts") == 1, F.col("number")).otherwise(
            F.concat_ws(".", "number", "part")))
    by_doc = Window.partitionBy("doc_id").orderBy("scene_no", "part")
    pieces = pieces.withColumn("scene_index", F.row_number().over(by_doc) - 1)
    units = units.join(pieces.select("doc_id", "scene_no", "part", "scene_index"),
                       ["doc_id", "scene_no", "part"])
    units = units.withColumn("sequence_index", F.row_number().over(
        scene_units().orderBy("run")) - 1).withColumns(
        {"confidence": F.lit(0.85), "method": F.lit("rule")})
    warnings = dropped.select("doc_id", F.lit("contents_entries_dropped").alias("code"),
                              F.lit(None).cast("long").alias("scene_index"))
    return (pieces.select("doc_id", "scene_index", "heading", "number"),
            units.select(*UNIT_COLUMNS), warnings)

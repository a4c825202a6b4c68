"""Parsers on small authored documents."""

import codecs

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotline.functions import headings
from plotline.functions.text import split_lines
from plotline.registry import load
from plotline.sources import fdx, ingest, layout, parsing, stage, truth

FOUNTAIN = """Title: Low Tide
Author: Nobody

Stray line.

INT. BOATHOUSE - NIGHT #11A#

Rain on tin. [[check the leak]]

ANNA (V.O.)
(tired)
We should go.
CUT TO:

@McKay
Why?

.Flashback

CLOSE ON THE KEY

> SLOW DISSOLVE
> THE END <
# Section
= synopsis
!LOUD action
/* gone
INT. NOWHERE - DAY
*/
MATÍAS ^
Sí.
"""


def units_of(frames):
    scenes, units, warnings = frames
    rows = units.orderBy("scene_index", "sequence_index").collect()
    return scenes, [(r.scene_index, r.unit_type, r.text, r.speaker) for r in rows], warnings


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_fountain(spark):
    scenes, units, warnings = units_of(parsing.fountain(one(spark, FOUNTAIN)))
    assert units == [
        (0, "action", "Stray line.", None),
        (1, "scene_heading", "INT. BOATHOUSE - NIGHT", None), (1, "action", "Rain on tin.", None),
        (1, "character", "ANNA (V.O.)", "ANNA"), (1, "parenthetical", "(tired)", "ANNA"),
        (1, "dialogue", "We should go.", "ANNA"), (1, "transition", "CUT TO:", None),
        (1, "character", "McKay", "McKay"), (1, "dialogue", "Why?", "McKay"),
        (1, "note", "check the leak", None),
        (2, "scene_heading", "Flashback", None), (2, "shot", "CLOSE ON THE KEY", None),
        (2, "transition", "SLOW DISSOLVE", None), (2, "action", "THE END", None),
        (2, "action", "LOUD action", None), (2, "character", "MATÍAS", "MATÍAS"), (2, "dialogue", "Sí.", "MATÍAS")]
    heads = {r.scene_index: (r.heading, r.number, r.int_ext, r.time_of_day) for r in scenes.collect()}
    assert heads == {0: ("", None, None, None), 1: ("INT. BOATHOUSE - NIGHT", "11A", "INT", "NIGHT"),
                     2: ("Flashback", None, None, None)}
    codes = {(r.code, r.scene_index) for r in warnings.collect()}
    assert codes == {("boneyard_discarded", None), ("content_before_first_scene", 0), ("dual_dialogue", 2)}


def test_fountain_offsets_point_into_the_source(spark):
    _, units, _ = parsing.fountain(one(spark, FOUNTAIN))
    for r in units.filter("unit_type NOT IN ('note', 'character')").collect():
        assert r.text in FOUNTAIN[r.start:r.end + 8]


INDENTED = """INT. HALL - DAY
  Light falls.
                    ANNA
        Hello there.
              (quietly)
        Again.

  She leaves.
        Indented action.
  CLOSE ON door
"""


def test_plain_indented_and_flat(spark):
    _, units, warnings = units_of(parsing.plain(one(spark, INDENTED)))
    assert [u[1:] for u in units] == [
        ("scene_heading", "INT. HALL - DAY", None), ("action", "Light falls.", None), ("character", "ANNA", "ANNA"),
        ("dialogue", "Hello there.", "ANNA"), ("parenthetical", "(quietly)", "ANNA"), ("dialogue", "Again.", "ANNA"),
        ("action", "She leaves.", None), ("action", "Indented action.", None), ("shot", "CLOSE ON door", None)]
    flat = "EXT. SEA - DAWN\n\nANNA\nLand!\n\nPOV\n\nGulls.\n"
    _, units, warnings = units_of(parsing.plain(one(spark, flat)))
    assert [u[1] for u in units] == ["scene_heading", "character", "dialogue", "shot", "action"]
    assert [r.code for r in warnings.collect()] == ["no_indentation"]


def test_tab_margin_keeps_the_published_formula(spark):
    """A tab counts as the one raw character it is, so tabbed lines stay at the margin."""
    text = "INT. A - DAY\n" + "\tLine of it\n" * 5
    _, units, warnings = parsing.plain(one(spark, text))
    assert {r.confidence for r in units.collect()} == {0.6}
    assert [r.code for r in warnings.collect()] == ["no_indentation"]


PLAY = """*** START OF THE PROJECT GUTENBERG EBOOK X ***
Contents

ACT I
SCENE II. A wood.

Persons Represented
Old Man, a man

ACT I

SCENE II. A wood. Trees everywhere around.

[Enter the
king.]

KING.
A speech that wraps
over two lines.

MRS. PEARCE. Certainly, [she nods
to him] sir.

_Exit KING._

ACT II

A bare room.

BOY
Hello.

THE END
footnote
*** END OF THE PROJECT GUTENBERG EBOOK X ***
"""


def test_stage_play(spark):
    scenes, units, warnings = units_of(stage.stage_play(one(spark, PLAY)))
    heads = {r.scene_index: (r.heading, r.number) for r in scenes.collect()}
    assert heads == {0: ("A wood", "1.2"), 1: ("A bare room", "2")}
    assert units == [
        (0, "scene_heading", "SCENE II. A wood. Trees everywhere around.", None),
        (0, "action", "[Enter the king.]", None), (0, "character", "KING.", "KING"),
        (0, "dialogue", "A speech that wraps over two lines.", "KING"),
        (0, "character", "MRS. PEARCE", "MRS. PEARCE"),
        (0, "dialogue", "Certainly, [she nods to him] sir.", "MRS. PEARCE"), (0, "action", "_Exit KING._", None),
        (1, "scene_heading", "A bare room.", None), (1, "character", "BOY", "BOY"), (1, "dialogue", "Hello.", "BOY")]


def test_long_act_splits_at_entrances(spark):
    body = "".join(f"NAME{i % 3}\nLine {i}.\n\n" + ("Enter a guest.\n\n" if i % 10 == 9 else "") for i in range(40))
    scenes, units, _ = stage.stage_play(one(spark, "ACT I\n\nA hall.\n\n" + body))
    numbers = [r.number for r in scenes.orderBy("scene_index").collect()]
    assert numbers == ["1.1", "1.2", "1.3", "1.4"]
    assert units.groupBy("scene_index").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] >= 8


def test_final_draft_and_refusals(spark):
    good = ('<?xml version="1.0"?><FinalDraft><Content><Paragraph Type="Scene Heading" Number="7"><Text>INT. X - DAY</Text>'
            '</Paragraph><Paragraph Type="Character"><Text>ANNA (O.S.)</Text></Paragraph><Paragraph Type="Dialogue">'
            '<Text>One </Text><Text Style="Bold">two</Text></Paragraph><Paragraph Type="Odd"><Text>POV of it</Text>'
            '</Paragraph></Content></FinalDraft>')
    docs = spark.createDataFrame([(1, good), (2, "<FinalDraft><Content>"), (3, "<Other><Content/></Other>"),
                                  (4, '<!DOCTYPE x [<!ENTITY a "b">]><FinalDraft/>'), (5, "<FinalDraft></FinalDraft>")],
                                 "doc_id long, text string")
    scenes, units, rejects = fdx.final_draft(docs)
    rows = units.orderBy("sequence_index").collect()
    assert [(r.unit_type, r.text, r.speaker) for r in rows] == [
        ("scene_heading", "INT. X - DAY", None), ("character", "ANNA (O.S.)", "ANNA"), ("dialogue", "One two", "ANNA"),
        ("shot", "POV of it", None)]
    assert scenes.first().number == "7"
    refused = {r.doc_id: r.rejection for r in rejects.collect()}
    assert refused[4] == "xml_unsafe" and refused[2] == "xml_malformed" and refused[3] == "fdx_wrong_root"
    assert set(refused) == {2, 3, 4, 5}


def test_positioned_lines(spark):
    rows = [(1, 1, 0, 72.0, 700.0, "12 INT. YARD - DAY 12"), (1, 1, 1, 72.0, 670.0, "Dust rises"),
            (1, 1, 2, 72.0, 658.0, "and settles."), (1, 1, 3, 200.0, 628.0, "ANNA"), (1, 1, 4, 120.0, 616.0, "Hello."),
            (1, 2, 0, 72.0, 700.0, "Night falls."), (1, 2, 1, 120.0, 660.0, "Lost.")]
    scenes, units = layout.positioned(spark.createDataFrame(
        rows, "doc_id long, page long, pos int, x double, y double, text string"))
    got = [(r.unit_type, r.text, r.confidence) for r in units.orderBy("block").collect()]
    assert got == [("scene_heading", "INT. YARD - DAY", 1.0), ("action", "Dust rises and settles.", 0.9),
                   ("character", "ANNA", 0.95), ("dialogue", "Hello.", 0.9), ("action", "Night falls.", 0.9),
                   ("action", "Lost.", 0.45)]
    assert scenes.first().number == "12"


def test_decoding_and_detection(spark):
    texts = {"bom16": codecs.BOM_UTF16_LE + "é – x".encode("utf-16-le"), "bom32": codecs.BOM_UTF32_LE + "y".encode("utf-32-le"),
             "cp": b"smart \x93quote\x94", "bad": b"\x81\x8d\xff", "utf": "plain é".encode()}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "name string, content binary")
    got = {r.name: (r.text, r.rejection) for r in ingest.decode(df).collect()}
    assert got == {"bom16": ("é – x", None), "bom32": ("y", None), "cp": ("smart “quote”", None),
                   "bad": (None, "undecodable_text"), "utf": ("plain é", None)}
    samples = [(b"%PDF-1.4", "pdf", 1.0), (b"\x00\x01binary", "unknown", 0.0), (b"   \n", "unknown", 0.0),
               (b"INT. X - DAY\n[[n]]\n@Bo\n", "fountain", 0.95), (b"prose only", "plain_text", 0.3),
               (b"ACT I\nACT II\nACT III\n" + b"BOB. Hi there.\n" * 5, "stage_play", 0.75)]
    rows = spark.createDataFrame([(i, bytearray(c), "f.txt") for i, (c, _, _) in enumerate(samples)],
                                 "i int, content binary, source_name string")
    found = ingest.detect(ingest.decode(ingest.identify(rows))).orderBy("i").collect()
    assert [(r.format, r.confidence) for r in found] == [(f, c) for _, f, c in samples]


def test_markdown_tables_without_divider_are_prose(spark):
    text = "# Scene 4 edges\n| a | b |\nnot a divider\n| Subject | Predicate | Object |\n|---|---|---|\n| Sc 4 | `uses` | Cup |\n"
    rows = truth.tables(one(spark, text)).collect()
    assert [(r.header, r.cells) for r in rows] == [(["Subject", "Predicate", "Object"], ["Sc 4", "`uses`", "Cup"])]


def test_block_numbers_cross_batches(spark):
    """Blocks are told line by line over batches of any size, without a Python call a page."""
    rows = [(d, p, n, 72.0 + 70.0 * (n * d % 3 == 1), -30.0 * n + 18.0 * (n % 4 == 3), "INT. HALL - DAY" if n % 5 == 0 else "x", n % 5 == 0)
            for d in (1, 2) for p in (1, 2, 3) for n in range(9)]
    names = ["doc_id", "page", "pos", "x", "y", "text", "solo"]
    whole = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    told = []
    for size in (1, 4, len(rows)):
        batches = [whole.slice(i, size) for i in range(0, len(rows), size)]
        told.append([n for b in layout.block_numbers(iter(batches)) for n in b.column("block").to_pylist()])
    assert told[0] == told[1] == told[2]
    want, seen = [], {}
    for d in (1, 2):
        block = -1
        for r in (r for r in rows if r[0] == d):
            if r[1] not in seen.setdefault(d, set()):
                edge = None
            seen[d].add(r[1])
            if edge is None or r[6] or abs(last - r[4]) > layout.BLOCK_GAP or abs(r[3] - edge) > layout.COLUMN_SHIFT:
                block, edge = block + 1, r[3]
            edge, last = None if r[6] else edge, r[4]
            want.append(block)
    assert told[0] == want
    frame = spark.createDataFrame([r[:6] for r in rows], "doc_id long, page long, pos int, x double, y double, text string")
    _, units = layout.positioned(frame)
    assert units.agg(F.max("block")).first()[0] == max(want)


@pytest.mark.parametrize("name, step, most", [("F5_parse_cue", "regexp_extract(", 3), ("F6_inline_cue", "regexp_extract(", 4)])
def test_a_cue_is_worked_out_once(spark, name, step, most):
    """a filter on the cue does not copy the cue's patterns, nor do its own steps."""
    plan = load()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(step) <= most and "regexp_extract(" not in "".join(x for x in plan.split("\n") if "Filter" in x)


def test_cue_edges(spark):
    rows = [(0, "ANNA (V.O.) (O.S.) ^"), (1, "_BO._"), (2, "FADE IN:"), (3, "CUT TO:"), (4, "MONTAGE"), (5, "END OF MONTAGE"),
            (6, "A (x^y)"), (7, None), (8, "  "), (9, "123"), (10, "Anna"), (11, "INT. HALL"), (12, "É")]
    cues = spark.createDataFrame(rows, "i int, x string").select("i", headings.cue(F.col("x")).alias("c"), headings.is_cue(F.col("x")).alias("k"))
    got = {r.i: (tuple(r.c) if r.c else None, r.k) for r in cues.collect()}
    assert got == {0: (("ANNA", "(V.O.) (O.S.)", True), True), 1: (None, False), 2: (None, False), 3: (None, False),
                   4: (("MONTAGE", None, False), True), 5: (None, False), 6: (None, False), 7: (None, None), 8: (None, False),
                   9: (None, False), 10: (None, False), 11: (None, False), 12: (("É", None, False), True)}
    lines = [(0, "ANNA. Go on"), (1, "MRS. DALE. Come in"), (2, "MRS. come in"), (3, "ACT ONE. So"), (4, "BO [aside] well"), (5, None),
             (6, "A. Too short"), (7, "ANNA.Go")]
    said = spark.createDataFrame(lines, "i int, x string").select("i", headings.inline_cue(F.col("x")).alias("c"))
    assert {r.i: tuple(r.c) if r.c else None for r in said.collect()} == {
        0: ("ANNA", "Go on"), 1: ("MRS. DALE", "Come in"), 2: None, 3: None, 4: ("BO", "[aside] well"), 5: None, 6: None, 7: None}


def test_lines_of_every_terminator(spark):
    texts = ["", "\n", "a", "a\n", "a\n\nb", "a\r\nb\rc", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed\x85e f ", "\n\n", "é\nü\n", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", split_lines(F.col("x")).alias("l")).collect()
    assert {r.i: r.l for r in rows} == {i: x if x is None else x.splitlines(keepends=True) for i, x in enumerate(texts)}


def test_only_table_lines_are_shuffled(spark):
    """prose is dropped before the lines meet by document."""
    found = truth.tables(one(spark, "# Scene 4\nprose\n | a | b |\n|---|---|\n| 1 | 2 |\n| - |\n\nx | y\n| lone |\n"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (StartsWith(" in plan[plan.rindex("Window ["):]
    assert sorted((r.table, r.heading, r.header, r.row, r.cells) for r in found.collect()) == [
        (2, "Scene 4", ["a", "b"], 0, ["1", "2"]), (2, "Scene 4", ["a", "b"], 1, ["-"])]

"""The import dataflow over files of mixed formats."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plotline import vocab
from plotline.plans import imports
from plotline.sources import ingest

SCENE = "INT. HALL {n} - DAY\n\nANNA\nWe should go now.\n\nThe door opens.\n\n"
FDX = ("<?xml version='1.0'?><FinalDraft><Content>" + "".join(
    f"<Paragraph Type='Scene Heading'><Text>EXT. YARD {n} - DAY</Text></Paragraph><Paragraph Type='Character'><Text>BO</Text></Paragraph>"
    "<Paragraph Type='Dialogue'><Text>Here.</Text></Paragraph><Paragraph Type='Action'><Text>Wind.</Text></Paragraph>"
    for n in range(3)) + "</Content></FinalDraft>")
PLAY = "ACT I\n\n" + "".join(f"SCENE {n}. A garden.\n\nANNA. I will not.\n\nBO. You will.\n\n[He leaves.]\n\n" for n in ("I", "II", "III"))
FOUNTAIN = {"fountain": imports.FORMATS["fountain"]}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("mixed")
    whole = "".join(SCENE.format(n=n) for n in range(3))
    files = {
        "low-tide.fountain": ("Title: Low Tide\n\n" + whole).encode(), "bom.fountain": ("Title: Marked\n\n" + whole).encode("utf-16"),
        "draft_two.txt": whole.encode(), "yard.fdx": FDX.encode(), "bad.fdx": FDX[:-20].encode(), "play.txt": PLAY.encode(),
        "letter.txt": b"Dear Sir,\n\nnothing here is a scene.\n", "none.txt": b"", "blank.txt": b" \n\t\n", "scan.pdf": b"%PDF-1.7 stream",
        "thin.txt": b"INT. HALL - DAY\n\nNothing is said.\n", "junk.bin": bytes(range(256)) * 4}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    with open(folder / "huge.txt", "wb") as f:
        f.truncate(vocab.MAX_UPLOAD_BYTES + 1)
    return folder


def test_each_file_has_its_outcome(spark, corpus, tmp_path):
    made = imports.import_corpus(ingest.read_files(spark, str(corpus)))
    got = {Path(r.source_name).name: r for r in made["imports"].collect()}
    assert len(got) == 12
    outcome = {name: (r.format, r.outcome, r.rejection) for name, r in got.items()}
    assert outcome["low-tide.fountain"] == ("fountain", "accepted", None)
    assert outcome["bom.fountain"] == ("fountain", "accepted", None)
    assert outcome["draft_two.txt"] == ("plain_text", "needs_review", None)
    assert outcome["yard.fdx"] == ("fdx", "accepted", None)
    assert outcome["bad.fdx"] == ("fdx", "rejected", "xml_malformed")
    assert outcome["play.txt"][:2] == ("stage_play", "accepted")
    assert outcome["letter.txt"] == ("plain_text", "rejected", "no_scenes")
    assert outcome["thin.txt"] == ("plain_text", "rejected", "not_a_screenplay")
    assert outcome["huge.txt"] == ("unknown", "rejected", "payload_too_large")
    for name in ("blank.txt", "scan.pdf"):
        assert outcome[name][1:] == ("rejected", "unsupported_format")
    assert outcome["junk.bin"][1] == "rejected"
    assert got["low-tide.fountain"].title == "Low Tide" and got["draft_two.txt"].title == "draft two"

    folder = str(tmp_path / "out")
    first = imports.publish(made, folder)
    kept = imports.published(spark, folder)
    assert sorted(kept) == sorted(imports.TABLES)
    assert kept["imports"].count() == 12 and kept["scripts"].count() == 5
    counts = {r.doc_id: r["count"] for r in kept["scenes"].groupBy("doc_id").count().collect()}
    assert sorted(counts.values()) == [3] * 5
    assert kept["units"].select("unit_id").distinct().count() == kept["units"].count()
    codes = {r.code for r in kept["warnings"].collect()}
    assert codes == {"no_indentation"}

    # A second import replaces what readers see; the first snapshot stays readable by name.
    few = spark.read.format("binaryFile").load(str(corpus / "yard.fdx")).select(
        "content", F.col("path").alias("source_name"))
    imports.publish(imports.import_corpus(few, {"fdx": imports.FORMATS["fdx"]}), folder)
    assert imports.published(spark, folder)["scripts"].count() == 1
    assert imports.published(spark, folder, first)["scripts"].count() == 5
    again = imports.published(spark, folder)["units"].select("unit_id")
    assert again.join(kept["units"], "unit_id", "left_anti").count() == 0


def test_an_unlisted_snapshot_is_not_seen_and_limits_are_warned_of(spark, corpus, tmp_path):
    files = ingest.read_files(spark, str(corpus)).filter(F.col("source_name").endswith("low-tide.fountain"))
    made = imports.import_corpus(files, FOUNTAIN, max_scenes=3, max_units=2)
    folder = str(tmp_path / "out")
    imports.publish(made, folder)
    ingest.write_corpus({"scripts": made["scripts"].limit(0)}, f"{folder}/snapshots/half")
    kept = imports.published(spark, folder)
    # Two units a scene are a heading and a cue: nobody speaks, so the verdict is against it.
    row = kept["imports"].first()
    assert (row.outcome, row.rejection) == ("rejected", "not_a_screenplay")
    assert kept["scripts"].count() == kept["units"].count() == kept["warnings"].count() == 0
    wide = imports.import_corpus(files, FOUNTAIN, max_units=3)
    assert wide["imports"].first().outcome == "needs_review"
    assert [r.code for r in wide["warnings"].orderBy("scene_index").collect()] == ["unit_limit"] * 3


def test_no_payloads_and_null_content(spark):
    none = spark.createDataFrame([], "doc_id string, content binary, source_name string")
    made = imports.import_corpus(none, FOUNTAIN)
    assert all(made[name].count() == 0 for name in imports.TABLES)
    bare = spark.createDataFrame([("a", None, None), ("b", bytearray(), "x/b-c.txt")], none.schema)
    rows = imports.import_corpus(bare, FOUNTAIN)["imports"].orderBy("doc_id").collect()
    assert [(r.doc_id, r.outcome, r.title) for r in rows] == [("a", "rejected", "Untitled"), ("b", "rejected", "b c")]

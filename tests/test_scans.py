"""Blocked scans give the rows a plain window gives, whatever counts as hot."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plotline.operators import joins, ledger, scans
from plotline.operators import windows as W
from plotline.operators.streamed import digests
from plotline.plans import build
from plotline.sources import sink

START = datetime(2024, 1, 1)


def calls(spark):
    gaps = [0, 5, 25, 45, 46, 66, 87, 87.5, 140, 161, 161, 200]
    rows = [(k, i, START + timedelta(minutes=g), i * 3) for k in ("a", None) for i, g in enumerate(gaps)]
    return spark.createDataFrame(rows, "k string, id long, at timestamp, n long")


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_ordinal_and_running_sum(spark, hot):
    df = calls(spark)
    order = [F.col("at"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    want = df.withColumn("r", F.row_number().over(w)).withColumn(
        "s", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = scans.running_sum(scans.ordinal(df, ["k"], order, "r", hot), ["k"], order, F.col("n"), "s", hot)
    key = ["k", "id", "r", "s"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_burst_borders(spark, hot):
    """Twenty minutes stay in the burst, anything longer opens the next."""
    got = scans.bursts(calls(spark), ["k"], "at", "id", 1200, "start", hot)
    starts = [r.start for r in got.filter("k = 'a'").orderBy("at", "id").collect()]
    minutes = [(s - START).total_seconds() / 60 for s in starts]
    assert minutes == [0, 0, 0, 0, 0, 0, 87, 87, 140, 161, 161, 200]


@pytest.mark.parametrize("hot", [1, 1000])
def test_first_question_within_two_minutes(spark, hot):
    made = spark.createDataFrame([(1, "s", START), (2, "s", START + timedelta(minutes=9)), (3, "t", START)],
                                 "call_id long, script_id string, created_at timestamp")
    asked = spark.createDataFrame(
        [("late", "s", START + timedelta(seconds=121)), ("yes", "s", START + timedelta(minutes=9, seconds=120)),
         ("later", "s", START + timedelta(minutes=10, seconds=125)), ("own", "t", START)],
        "question string, script_id string, asked_at timestamp")
    got = {r.call_id: r.question for r in ledger.answered_by(made, asked, "script_id", hot).collect()}
    assert got == {2: "yes", 3: "own"}


def test_forced_run_inside_a_burst(spark):
    spans = spark.createDataFrame([("x", "s", START, START + timedelta(minutes=5)),
                                   ("y", "s", START + timedelta(hours=1), START + timedelta(hours=2))],
                                  "id string, script_id string, first timestamp, last timestamp")
    runs = spark.createDataFrame([("s", START + timedelta(minutes=6)), ("s", START + timedelta(hours=2))],
                                 "script_id string, started_at timestamp")
    assert [r.id for r in ledger.holding(spans, runs, "script_id", "id", 1).collect()] == ["y"]


@pytest.mark.parametrize("hot", [1, 1000])
def test_last_mark_before(spark, hot):
    marks = spark.createDataFrame([("d", 5, 50), ("d", 20, 200)], "k string, at long, mark long")
    rows = spark.createDataFrame([("d", 1, 1), ("d", 5, 2), ("d", 19, 3), ("d", 300, 4)], "k string, at long, row long")
    got = joins.last_before(rows, marks, ["k"], "at", "row", "mark", hot)
    assert {r.row: r.mark for r in got.collect()} == {1: None, 2: 50, 3: 50, 4: 200}


KINDS = ["character", "dialogue", "parenthetical", "action", "action", "note"]


def scenes_of(spark, lengths):
    """Scenes of given lengths with runs, silent cues, gaps in the numbering and null texts and speakers."""
    rows = []
    for scene, n in enumerate(lengths):
        for i in range(n):
            kind = KINDS[(i * i + scene) % 6] if i % 9 < 6 else "dialogue"
            rows.append((scene, 3 * i + scene, f"{scene}-{i}", kind, None if i % 13 == 5 else f"t{i} el" + (" queque" if i % 17 == 4 else ""),
                         "EVE" if kind == "character" and i % 4 else ("ADAM" if kind == "dialogue" and i % 5 == 0 else None)))
    return spark.createDataFrame(rows, "scene_id long, sequence_index long, unit_id string, unit_type string, text string, speaker string")


@pytest.mark.parametrize("hot", [1, 7])
def test_segmented_scans_do_not_depend_on_blocks(spark, hot):
    units = scenes_of(spark, [40, 1, 23, 7, 2]).repartition(3)
    cited = units.filter("sequence_index % 4 = 0").select("unit_id")
    hit = F.contains("text", F.lit("queque"))
    jobs = {
        "carried": lambda h: W.carried(units, "cue", F.when(F.col("unit_type") == "character", F.col("text")), h),
        "wrapped": lambda h: W.join_wrapped(units, h),
        "settled": lambda h: W.settle_cues(units, cited, False, h),
        "settled_last": lambda h: W.settle_cues(units, cited, True, h),
        "above": lambda h: W.speaker_above(units, h),
        "window": lambda h: W.context_window(units, hit, 2, 9, h),
        "read": lambda h: W.read_windows(units, 4, h),
    }
    for name, job in jobs.items():
        plain, cut = job(None), job(hot)
        assert sorted(plain.columns) == sorted(cut.columns), name
        assert sorted(map(str, cut.select(*plain.columns).collect())) == sorted(map(str, plain.collect())), name


def test_window_against_plain_python(spark):
    units = scenes_of(spark, [60])
    lines = [r.text for r in units.orderBy("sequence_index").collect()]
    hits = [i for i, x in enumerate(lines) if x and "queque" in x]
    near = [i for i in range(60) if any(abs(i - h) <= 2 for h in hits)]
    got = W.context_window(units, F.contains("text", F.lit("queque")), 2, 9, 5).collect()
    assert sorted(r.sequence_index // 3 for r in got) == near[:9] and {r.total for r in got} == {len(near)}


def test_blocks_of_one_key_hold_bounded_rows(spark):
    rows = spark.range(40_000).selectExpr("0 as k", "(id * 7919) % 40000 as at", "1 as one")
    scan = scans.Scan(rows, ["k"], [F.col("at")], 4000)
    sizes = [r["count"] for r in scan.frame.groupBy("_block").count().collect()]
    assert scan.cut and max(sizes) <= 4000 and len(sizes) > 10
    total = scan.total("n", F.col("one")).done()
    assert total.filter("n <> at").isEmpty()
    lone = scans.Scan(rows, ["at"], [F.col("one")], 4000)
    assert not lone.cut


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_digests_follow_the_order_across_batches(spark, parts):
    import hashlib
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = [(k, i, None if i % 11 == 3 else f"é{i};") for k in range(parts) for i in range(40)]
        frame = spark.createDataFrame(data + [(None, 0, "x")], "k long, i long, t string").repartition(4)
        got = dict(map(tuple, digests(frame, "k", [F.col("i")], F.col("t"), "d", "md5").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: hashlib.md5("".join(t or "" for q, _, t in data if q == k).encode()).hexdigest() for k in range(parts)}


def test_scene_hash_of_odd_scenes(spark):
    import hashlib
    scenes = spark.createDataFrame([(1, "HALL"), (2, "EMPTY"), (3, None)], "scene_id long, heading string")
    units = spark.createDataFrame([(1, 2, "action", "b"), (1, 1, "action", "a"), (1, 3, None, "x"), (1, 4, "action", None), (3, 1, "action", "z"), (9, 1, "a", "b")],
                                  "scene_id long, sequence_index long, unit_type string, text string")
    got = {r.scene_id: r.input_hash for r in build.scene_hash(scenes, units, "v").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: sha("v\0HALL\0action\0a\0action\0b"), 2: sha("v\0EMPTY"), 3: None}


@pytest.mark.parametrize("hot", [None, 2])
def test_parts_of_a_script_join_to_its_text(spark, hot):
    scripts = spark.createDataFrame([(1, "One"), (2, "Bare")], "script_id long, title string")
    scenes = spark.createDataFrame([(1, 0, "INT. HALL - DAY", False), (1, 1, "the attic", False), (1, 2, "", True)],
                                   "script_id long, scene_index long, heading string, omitted boolean")
    units = spark.createDataFrame([
        (1, 0, 0, "scene_heading", "INT. HALL - DAY"), (1, 0, 1, "character", "Eve"), (1, 0, 2, "parenthetical", "low"), (1, 0, 3, "dialogue", "Hello."),
        (1, 0, 4, "action", "She goes."), (1, 0, 5, "dialogue", "No cue."), (1, 0, 6, "transition", "Fade"), (1, 1, 0, "note", "check"),
        (1, 1, 1, "action", None)], "script_id long, scene_index long, sequence_index long, unit_type string, text string")
    want = ("Title: One\n\nINT. HALL - DAY\n\nEVE\n(low)\nHello.\n\nShe goes.\n\nNo cue.\n\n> Fade\n\n.the attic\n\n[[check]]\n\n.SCENE\n\nOMITTED\n")
    for size in (1, 20, 10_000):
        parts = sink.export_parts(scripts, scenes, units, size, hot)
        joined = {}
        for r in parts.orderBy("script_id", "part").collect():
            joined[r.script_id] = joined.get(r.script_id, "") + r.text
        assert joined == {1: want, 2: "Title: Bare\n"}
    assert {r.script_id: r.text for r in sink.export_fountain(scripts, scenes, units).collect()} == joined


def test_hot_rows_are_not_gathered_by_their_key(spark, monkeypatch):
    """One key holds all rows: they meet the list of hot keys where they are, whatever the planner may broadcast."""
    kept, durable = [], scans.durable
    monkeypatch.setattr(scans, "durable", lambda df: kept.append(df) or durable(df))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select((F.col("id") / 1000).cast("long").alias("k"), "id")
        got = scans.running_sum(df, ["k"], [F.col("id")], F.lit(1), "n", 10).collect()
        assert sorted((r.id, r.n) for r in got) == [(i, i) for i in range(100)]
        plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

"""Streaming jobs over several batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.operators import ledger
from plotline.registry import load
from plotline.sources import ingest
from plotline.sources.tables import SCHEMAS
from plotline.streaming import jobs

SHAPE = "scene_id long, unit_id long, sequence_index long, unit_type string, text string, heading string"


def cast(spark, folder):
    store = jobs.graph_store(spark, folder, T.LongType(), T.LongType())
    return sorted((r.scene_id, r.entity_type, r.name, r.lines) for r in jobs.current_graph(store).collect())


def test_rule_graph_keeps_what_earlier_batches_brought(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*lines):
        spark.createDataFrame(list(lines), SHAPE).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SHAPE).parquet(inbox)
        jobs.rule_graph(stream, out, f"{out}-state", "v1").awaitTermination()
        return cast(spark, out)

    head = "INT. HALL - DAY"
    first = arrive((1, 0, 0, "scene_heading", head, head), (1, 1, 1, "character", "MARA", head), (1, 2, 2, "character", "TOM", head),
                   (2, 5, 0, "character", "OLGA", head), (None, 9, 0, "character", "NOBODY", head), (1, None, 0, "character", "NOBODY", head))
    hall = (1, "location", "HALL", 1)
    assert first == [(1, "cast", "MARA", 1), (1, "cast", "TOM", 1), hall, (2, "cast", "OLGA", 1)]
    more = arrive((1, 3, 3, "character", "EVE", head))
    assert more == [(1, "cast", "EVE", 1), (1, "cast", "MARA", 1), (1, "cast", "TOM", 1), hall, (2, "cast", "OLGA", 1)]
    changed = arrive((1, 2, 2, "character", "MARA", head))
    assert changed == [(1, "cast", "EVE", 1), (1, "cast", "MARA", 2), hall, (2, "cast", "OLGA", 1)]
    back = arrive((1, 2, 2, "character", "TOM", head), (1, 3, 3, "character", "EVE", head))
    assert back == more
    assert arrive((2, 5, 0, "character", "OLGA", head)) == more


def test_twin_is_the_newest_import_before(spark):
    frame = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "b", 4), (5, "a", 3)],
                                  "import_id long, content_hash string, imported_at long")
    for hot in (None, 1):
        got = ingest.twins(frame, hot).collect()
        assert sorted((r.import_id, r.twin_id, r.copies) for r in got) == [(2, 1, 1), (3, 2, 2), (5, 3, 3)]


def test_batches_read_a_level_number_of_files(spark, tmp_path):
    """Nine batches over two scenes: no bucket ever has more than the allowed parts, and the graph is that of one batch."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    store = jobs.graph_store(spark, out, T.LongType(), T.LongType(), buckets=4, most=2)
    counts = []
    for k in range(9):
        rows = [(k % 2, k, k, "character", f"NAME{k % 7}", "INT. HALL - DAY")]
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SHAPE).parquet(inbox)
        jobs.rule_graph(stream, out, f"{out}-state", "v1", buckets=4, most=2).awaitTermination()
        counts.append(max(len(held) for held in store.parts(store.newest_manifest()).values()))
    assert max(counts) <= 2 and store.newest_manifest() == 8
    whole = str(tmp_path / "whole")
    jobs.rule_graph(spark.readStream.schema(SHAPE).parquet(inbox), whole, f"{whole}-state", "v1").awaitTermination()
    got = sorted(map(str, jobs.current_graph(store).drop("batch").collect()))
    assert got == sorted(map(str, jobs.current_graph(jobs.graph_store(spark, whole, T.LongType(), T.LongType())).collect()))


def test_budget_state_over_batches_equals_the_ledger(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i // 2), "ab"[i % 3 % 2], i % 11, None if i % 5 == 0 else i % 7) for i in range(60)]
    shape = "call_id long, created_at timestamp, model_id string, input_tokens long, output_tokens long"
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:25], rows[25:26], rows[26:]):
        spark.createDataFrame(part, shape).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(shape).parquet(inbox)
        jobs.budget_gate(stream, ["model_id"], 90, out, f"{out}-state").awaitTermination()
    got = {r.call_id: (r.spent_before, r.refused) for r in spark.read.parquet(out).collect()}
    want = {}
    for k in "ab":
        frame = spark.createDataFrame([r for r in rows if r[2] == k], shape)
        for hot in (None, 4):
            want |= {r.call_id: (r.spent_before, r.refused) for r in ledger.budget_gate(frame, 90, hot).collect()}
            assert {c: got[c] for c in want} == want
    assert len(want) == 60 and any(r for _, r in want.values()) and not all(r for _, r in want.values())


def parted(spark, folder, *tables):
    """The smallest tables, each as a folder of parts."""
    for name in tables:
        source = f"/root/testdata/sf0.001/{name}.parquet"
        spark.read.schema(SCHEMAS[name]).parquet(source).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return "/root/testdata/sf0.001", folder


def test_copies_of_a_table_in_parts(spark, tmp_path):
    one, parts = (load()["T1_stream_dedupe"].run(spark, f) for f in parted(spark, str(tmp_path), "documents", "labels"))
    got = sorted(r.content_hash for r in parts.collect())
    assert got and got == sorted(r.content_hash for r in one.collect())


def test_rule_graph_of_a_table_in_parts(spark, tmp_path):
    one, parts = (load()["T3_stream_rule_graph"].run(spark, f) for f in parted(spark, str(tmp_path), "conversations"))
    got = sorted(map(str, parts.collect()))
    assert got and got == sorted(map(str, one.collect()))


def test_rule_graph_of_odd_conversations(spark, tmp_path):
    """Copies of a turn, two speakers of one, no first turn, no role, no turn and no conversation: as the SQL says."""
    import duckdb

    from tools.check import rows
    talk = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (2, 3, "user", "c"), (2, 4, "assistant", "d"), (3, 0, "tool", "e"),
            (3, 0, "assistant", "e"), (4, 0, None, "f"), (4, 1, "system", "g"), (5, None, "user", "h"), (None, 0, "user", "i")]
    spark.createDataFrame(talk, SCHEMAS["conversations"]).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    entry = load()["T3_stream_rule_graph"]
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = rows(entry.run(spark, str(tmp_path)).toPandas()), rows(connection.execute(entry.sql).df())
    assert got == want and len(want) == 10

"""Registered queries against their checking SQL on the smallest tables."""

import duckdb
import pytest

from plotline.registry import load
from plotline.sources.tables import SCHEMAS
from tools.check import rows

FOLDER = "/root/testdata/sf0.001"
# Assertion ids are line-item keys. One key occurs twice in the smallest tables, and
# these rewrite rows by id, so they are compared where the ids are unique.
UNIQUE_IDS = "/root/testdata/sf0.01"
BY_ID = {"G3_apply_changes", "G11_merge_entities", "G5_undo_facts"}
CHOSEN = [
    "S1_content_identity", "S2_decode_text", "S4_line_offsets", "S5_fountain_units", "S8_final_draft_units",
    "F1_normalize", "F4_split_heading", "F5_parse_cue", "F7_act_scene_ordinal", "F20_json_reply", "P4_node_labels",
    "P12_unusable_names", "P15_dedupe_key", "J6_phrase_containment", "J7_interval_join", "J16_asof_offset",
    "A6_billable_actions", "A20_grounding_metrics", "W2_burst_sessions", "W8_settle_cues", "O1_paged_list",
    "O6_find_scene", "U5_ungrounded_names", "G1_graph_diff", "G3_apply_changes", "G6_orphaned_references",
    "G11_merge_entities", "G13_resolve_entities", "G16_verify_verdicts", "G28_carry_graph", "G29_draft_chains",
    "G45_budget_gate", "S11_duplicate_twins", "S12_corpus_tables", "G15_validate_replies", "G17_verify_findings",
    "J15_positional_zip", "T2_stream_bursts", "T3_stream_rule_graph", "F8_location_of", "F19_line_type", "J11_named_in_question",
    "J12_all_words_join", "J14_lineage_join", "G8_continuity_packet", "G20_listed_facts", "G25_exact_alignment", "G33_changed_lines",
    "S10_cut_units", "S12_import_corpus", "A11_run_progress", "A12_variance_alerts", "F22_preview_summary", "F23_stale_findings", "F25_answer_line", "G5_reject",
    "G5_undo_facts", "G5_undo_texts", "G5_undo_states"]
# Queries that read whole conversations, run on one of five thousand turns.
LONG = ["W3_carry_forward", "W4_running_page", "W5_join_wrapped_lines", "W8_settle_cues", "W9_speaker_above", "W10_context_window",
        "W12_read_windows", "F14_content_hash", "J18_first_mention", "P17_scene_body", "S15_fountain_export", "T3_stream_rule_graph"]


def database(folder):
    connection = duckdb.connect()
    for name in SCHEMAS:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHOSEN)
def test_agrees_with_sql(spark, name):
    entry = load()[name]
    folder = UNIQUE_IDS if name in BY_ID else FOLDER
    got = entry.run(spark, folder).toPandas()
    want = database(folder).execute(entry.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def long_talks(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    connection = duckdb.connect()
    connection.execute(f"""COPY (SELECT c AS conv_id, t AS turn, CASE WHEN hash(c * 7919 + t) % 5 = 0 THEN 'system' WHEN hash(c * 31 + t) % 2 = 0
        THEN 'user' ELSE 'assistant' END AS role, 'line el ' || hash(t + c) || CASE WHEN t % 700 = 3 THEN ' queque' ELSE '' END AS text
        FROM (SELECT 1::BIGINT AS c, range AS t FROM range(5000) UNION ALL SELECT 2, range FROM range(4)))
        TO '{folder}/conversations.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.parametrize("name", LONG)
def test_long_conversations_stay_whole(spark, long_talks, name):
    entry = load()[name]
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{long_talks}/conversations.parquet'")
    got, want = entry.run(spark, long_talks).toPandas(), connection.execute(entry.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_operator_is_registered():
    found = {name.split("_")[0] for name in load()}
    sizes = {"S": 16, "P": 17, "J": 21, "A": 23, "W": 13, "O": 8, "U": 5, "F": 25, "G": 50, "T": 4}
    assert found == {f"{letter}{n}" for letter, last in sizes.items() for n in range(1, last + 1)}

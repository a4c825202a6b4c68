"""Registered queries against their SQL on texts that the smallest tables lack."""

import duckdb
import pytest

from plotline.registry import load
from plotline.sources.tables import SCHEMAS
from tools.check import rows

TABLES = {
    # A roman numeral that adds up to nothing has no ordinal.
    "F7_act_scene_ordinal": ("documents", [(3, "Vvx here. Mill", "en", "web", 14), (4, "Vvx. Xiv", "en", "web", 4)]),
    # A line of the text itself reads as a scene heading.
    "S3_detect_format": ("documents", [(1, "One line.\nEst aire ou non.", "fr", "web", 6), (2, "One line.", "fr", "web", 6)]),
    # Only a line feed ends a line, and the last one has an empty line behind it.
    "S4_line_offsets": ("documents", [(1, "", "en", "web", 0), (2, "One.\n", "en", "web", 5), (3, "\n\n", "en", "web", 2), (4, None, "en", "web", 0),
                                      (5, "One\rtwo\u2028three\x0c\r\nÉ\U0001f600\x85.", "en", "web", 20)]),
    # A line of a turn is a cue with its speech.
    "S7_stage_play_units": ("conversations", [
        (1, 0, "user", "One.\nSS. Two here.\nThree."), (1, 1, "assistant", "MRS. HALL. Four.\nFive."), (1, 2, "user", "Six."), (1, 3, "user", "Seven.")]),
}


@pytest.mark.parametrize("name", TABLES)
def test_rare_lines_agree_with_sql(spark, tmp_path, name):
    table, held = TABLES[name]
    spark.createDataFrame(held, SCHEMAS[table]).toPandas().to_parquet(tmp_path / f"{table}.parquet")
    entry = load()[name]
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got, want = entry.run(spark, str(tmp_path)).toPandas(), connection.execute(entry.sql).df()
    assert len(got) and rows(got) == rows(want)


def test_short_text_outside_ascii_is_imported_as_binary(spark, tmp_path):
    """Five characters of six bytes, one of which does not print."""
    held = {"documents": [(2, "Éaux.", "fr", "web", 5), (5, "Des eaux.", "fr", "web", 9)], "conversations": [(1, 0, "user", "One.")]}
    connection = duckdb.connect()
    for table, given in held.items():
        spark.createDataFrame(given, SCHEMAS[table]).toPandas().to_parquet(tmp_path / f"{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    entry = load()["S12_import_corpus"]
    got, want = entry.run(spark, str(tmp_path)).toPandas(), connection.execute(entry.sql).df()
    assert rows(got) == rows(want)
    assert sorted(got[got.doc_id.isin(["d2", "d5"])].format) == ["plain_text", "unknown"]

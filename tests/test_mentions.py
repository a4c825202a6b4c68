"""Names in texts: which side of the gram join may be broadcast."""

import pytest
from pyspark.sql import functions as F

from plotline.operators import mentions


@pytest.mark.parametrize("few", [1, 50_000])
def test_grams_are_never_broadcast(spark, tmp_path, monkeypatch, few):
    """The texts are one well packed file, smaller than the names' files, so that the planner takes their grams for the small side."""
    monkeypatch.setattr(mentions, "FEW", few)
    held = spark.range(300).select(F.col("id").alias("text_id"), F.concat(F.lit("int. blue ring "), F.col("id") % 7).alias("text"))
    held.coalesce(1).write.parquet(f"{tmp_path}/texts")
    named = [("blue ring 3",), ("ring",), ("red",), ("g 5",)]
    spark.createDataFrame(named, "name string").repartition(9).write.parquet(f"{tmp_path}/names")
    texts, names = spark.read.parquet(f"{tmp_path}/texts"), spark.read.parquet(f"{tmp_path}/names").withColumn("name_id", F.col("name"))
    found = mentions.substring_hits(texts, names)
    want = sorted((i, n) for i in range(300) for (n,) in named if n in f"int. blue ring {i % 7}")
    assert sorted((r.text_id, r.name) for r in found.collect()) == want
    words = texts.select("text_id", F.split("text", " ").alias("words"))
    sought = names.select("name_id", F.split("name", " ").alias("name_words"))
    phrases = mentions.phrase_hits(words, sought)
    assert {r.name_id for r in phrases.collect()} == {"blue ring 3", "ring"}
    for frame in (found, phrases):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("Join" in plan)


def test_answers_are_never_broadcast(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("answer_id"), F.lit("The blue ring and a red hat").alias("answer")).coalesce(1).write.parquet(f"{tmp_path}/a")
    answers = spark.read.parquet(f"{tmp_path}/a")
    names = spark.createDataFrame([("red hat",), ("blue ring",), ("hat",)], "name string")
    found = mentions.ungrounded_names(answers, answers.select("answer_id", F.lit("blue ring").alias("name")), names)
    assert sorted((r.answer_id, r.name) for r in found.collect()) == sorted((i, n) for i in range(300) for n in ("red hat", "hat"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 3


def test_every_word_of_the_names_agrees_with_sql(spark):
    """A13 at the smallest scale, its grams met by broadcast names."""
    from plotline.registry import load
    from tests.test_queries import FOLDER, database
    from tools.check import rows
    entry = load()["A13_entity_coverage"]
    got = entry.run(spark, FOLDER)
    assert "BuildLeft" not in mentions.substring_hits(
        spark.read.parquet(f"{FOLDER}/part.parquet").select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("text")),
        spark.createDataFrame([("ring", "ring")], "name_id string, name string"))._jdf.queryExecution().executedPlan().toString()
    assert rows(got.toPandas()) == rows(database(FOLDER).execute(entry.sql).df())

"""Partitions sized by the bytes of the texts: the same rows however many there are."""

import numpy as np
from pyspark.sql import functions as F

from plotline.llm import buffers, exchange, pieces, shingles, suffixes, vocabulary

FOLDER = "/root/testdata/sf0.001"


def test_partitions_follow_the_bytes(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    path = vocabulary.tokenizer_path("piece_bpe_32k.model")
    jobs = [lambda: pieces.token_counts(docs, path), lambda: shingles.linked(docs), lambda: suffixes.repeats(docs)]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert exchange.dealing(docs).tasks is None
    few = [sorted(map(tuple, job().collect())) for job in jobs]
    monkeypatch.setattr(exchange, "PART_BYTES", -(-size // 512))
    monkeypatch.setattr(exchange, "MOST_TASKS", 16)
    assert exchange.dealing(docs) == (512, 16)
    assert [sorted(map(tuple, job().collect())) for job in jobs] == few


def test_dealing_by_part_needs_no_second_exchange(spark):
    rows = spark.createDataFrame([(p, 0, 0, b"") for p in range(64)], exchange.ROWS)
    dealt = exchange.answered(rows, lambda payloads: [np.zeros(0, np.uint8) for _ in payloads], 16)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(r.part for r in dealt.collect()) == list(range(64))
    each = rows.repartitionById(16, "part").groupBy(F.spark_partition_id()).count().collect()
    assert {r["count"] for r in each} == {4}


def test_empty_and_null_texts_need_no_partitions_of_their_own(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert exchange.dealing(none).tasks is None and exchange.dealing(none.where("1 = 0")).tasks is None


def test_anchors_fall_into_partitions_evenly():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 1 << 20, dtype=np.uint8)
    anchors = suffixes.Anchors(data, np.array([0, len(data)]))
    held = np.bincount(exchange.part_of(suffixes.dealt(anchors.rank), 256), minlength=256)
    assert held.max() < 1.3 * held.mean()
    assert np.bincount(exchange.part_of(anchors.rank, 256), minlength=256).max() > 10 * held.mean()
    assert len(np.unique(suffixes.dealt(anchors.rank))) == len(np.unique(anchors.rank))
    assert buffers.BLOCK_BYTES <= exchange.PART_BYTES

"""Packing in groups sized by what fills a sequence: limits that bind, full sequences, placement against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.llm import packing, vocabulary

SCHEMA = packing.PIECES


def items(spark, n, length, loss):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.expr(length).cast("long").alias("length"),
                                 F.lit(0).cast("long").alias("ids_crc32"), F.expr(length).cast("long").alias("doc_tokens"),
                                 F.expr(loss).cast("long").alias("loss"), F.col("id").alias("salt"))


def sequences(frame):
    return frame.groupBy("sequence_id").agg(F.sum("length").alias("ids"), F.count("*").alias("segments"), F.sum("loss").alias("loss")).collect()


@pytest.mark.parametrize("length, loss, limits, binding", [
    ("1", "0", {"size": 4096, "segments": 64, "loss": 4096}, "segments"),
    ("10 + id % 90", "10 + id % 90", {"size": 4096, "segments": 1024, "loss": 1000}, "loss"),
    ("10 + id % 90", "id % 10", {"size": 1000, "segments": 1024, "loss": 4096}, "ids"),
])
def test_each_limit_binds(spark, length, loss, limits, binding):
    found = sequences(packing.packed(items(spark, 20_000, length, loss), full=32, **limits))
    for s in found:
        assert s.ids <= limits["size"] and s.segments <= limits["segments"] and s.loss <= limits["loss"]
    most = {"ids": limits["size"], "segments": limits["segments"], "loss": limits["loss"]}[binding]
    needed = -(-sum(s[binding] for s in found) // most)
    assert len(found) <= 1.12 * needed
    assert sum(s.segments for s in found) == 20_000


def plain(demand, limits):
    """A sequence at a time: of the items that fit, one whose shares have the largest dot product with the room left."""
    left, bins, totals = list(range(len(demand))), {}, []
    number = 0
    while left:
        room = limits.copy()
        while fitting := [i for i in left if (demand[i] <= room).all()]:
            best = max(fitting, key=lambda i: ((demand[i] / limits) @ (room / limits), tuple(-demand[i]), -i))
            bins[best], room = number, room - demand[best]
            left.remove(best)
        totals.append(tuple(limits - room))
        number += 1
    return [bins[i] for i in range(len(demand))], totals


@pytest.mark.parametrize("seed", range(4))
def test_placement_is_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    demand = np.column_stack([rng.integers(1, 60, 200), np.ones(200, np.int64), rng.integers(0, 50, 200)])
    limits = np.array([128, 8, 128])  # powers of two, so that shares are exact and ties are ties
    want, _ = plain(demand, limits)
    assert packing.place(demand, limits).tolist() == want


def test_short_documents_fill_sequences(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a").alias("text"))
    found = sequences(packing.sequences(docs, vocabulary.tokenizer_path("word_bpe_49k.json"), 2))
    assert sorted(s.segments for s in found)[1:] == [1024] * 8 and len(found) == 9


def test_nothing_to_pack(spark):
    assert packing.packed(items(spark, 0, "1", "0")).count() == 0

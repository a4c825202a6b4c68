"""SimHash classes against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plotline.llm import simhash
from tests.llm.test_operators import corpus, empty, odd, rows, texts  # noqa: F401


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(words[k:k + 3]).encode(), seed=42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_hand(source):
    marks = [(i, fingerprint(t)) for i, t in source]
    root = {i: i for i, _ in source}

    def find(x):
        return x if root[x] == x else find(root[x])
    for a in range(len(marks)):
        for b in range(a):
            if (marks[a][1] ^ marks[b][1]).bit_count() <= 2:
                p, q = find(marks[a][0]), find(marks[b][0])
                root[max(p, q)] = min(p, q)
    return sorted((i, f"{f:016x}", find(i)) for i, f in marks)


@pytest.mark.parametrize("crowded", [2048, 2])
def test_classes(spark, odd, corpus, crowded):  # noqa: F811
    rng = random.Random(crowded)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice([1, 3, 9, 120]))] for _ in range(8)]

    def near(words):
        words = list(words)
        if rng.random() < .7:
            words[rng.randrange(len(words))] = rng.choice("klmnop")
        return rng.choice([" ", "\n"]).join(words)
    made = [(k, near(rng.choice(base))) for k in range(200)] + [(5, "x y z"), (5, ""), (900, None), (901, " \t"), (77, "one two"), (None, "x y z")]
    made = spark.createDataFrame(made, "doc_id long, text string").withColumns({"fp": F.lit("x"), "vertex": F.lit(1), "mask": F.lit(2)})
    for frame in (made, odd, corpus, empty(odd)):
        assert rows(simhash.linked(frame, crowded)) == by_hand(texts(frame))


@pytest.mark.parametrize("crowded", [2048, 4])
def test_no_link_is_lost_among_crowded_fingerprints(spark, crowded):
    rng = random.Random(3)
    heart = rng.getrandbits(64)
    marks = {heart}
    while len(marks) < 700:
        mark = heart
        for _ in range(rng.randint(1, 7)):
            mark ^= 1 << rng.randrange(64)
        marks.add(mark)
    marks = sorted(marks)
    table = spark.createDataFrame([(simhash.signed(m), i) for i, m in enumerate(marks)], "fp long, doc_id long")
    got = simhash.components(simhash.links(simhash.cells(simhash.tabled(table), crowded)))
    root = list(range(len(marks)))

    def find(x):
        return x if root[x] == x else find(root[x])
    for a in range(len(marks)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    label = dict(map(tuple, got.collect()))
    assert [label.get(i, i) for i in range(len(marks))] == [find(i) for i in range(len(marks))]


def test_references_bound_the_filter():
    pivots = simhash.references()
    assert len(set(pivots.tolist())) == 64
    rng = np.random.default_rng(0)
    for bits in range(1, 65):
        x = rng.integers(0, 2 ** 63, dtype=np.uint64)
        y = x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, bits, replace=False).astype(np.uint64))
        gap = np.bitwise_count(x ^ pivots).astype(int) - np.bitwise_count(y ^ pivots).astype(int)
        assert (gap ** 2).sum() == 64 * bits and np.abs(gap).max() <= bits


def test_long_text_is_counted_in_runs():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(9)) for _ in range(300_000))
    data = np.frombuffer(text.encode(), np.uint8)
    h, row = simhash.shingles(data, np.array([0, len(data)]))
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert len(h) == 299_998 and int(simhash.majority(h, row, 1)[0]) == want

"""The classifier chain against plain Python, and what its sample holds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.llm import toxicity


def made(rng, n):
    """(text, quality, toxic): some words tell of one category, some of the other."""
    rows = []
    for _ in range(n):
        poor, toxic = rng.random() < 0.5, rng.random() < 0.4
        words = [rng.choice(["one", "two", "three", "four", "five"]) for _ in range(8)]
        words += ["spammy"] * poor + ["vile"] * (toxic and rng.random() < 0.9) + ["cheap"] * (poor and toxic)
        rng.shuffle(words)
        rows.append((" ".join(words), 1 - int(poor), int(toxic)))
    return rows


def plain_model(features, dense, labels, rounds=80, decay=1e-3):
    """The logistic model over sets and lists, one row at a time."""
    n, yes = len(labels), sum(labels)
    count, inside = {}, {}
    for row, y in zip(features, labels):
        for f in row:
            count[f] = count.get(f, 0) + 1
            inside[f] = inside.get(f, 0) + y
    kept = set()
    for f, c in count.items():
        share = c / n
        error = math.sqrt(max(share * (1 - share), 1e-12) * (1 / max(1, yes) + 1 / max(1, n - yes)))
        if c >= toxicity.LEAST_DOCS and abs((inside[f] / max(1, yes) - (c - inside[f]) / max(1, n - yes)) / error) >= toxicity.LEAST_Z:
            kept.add(f)
    width = len(dense[0]) if dense else 0
    w, d, b = dict.fromkeys(kept, 0.0), [0.0] * width, 0.0
    sw, sd, sb = dict.fromkeys(kept, 1e-12), [1e-12] * width, 1e-12

    def predict(row, extra):
        z = b + sum(w.get(f, 0.0) for f in row) + sum(x * y for x, y in zip(extra, d))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    for _ in range(rounds):
        gw, gd, gb = {f: decay / n * w[f] for f in kept}, [0.0] * width, 0.0
        for row, extra, y in zip(features, dense, labels):
            g = (predict(row, extra) - y) * (0.5 / max(1, yes) if y else 0.5 / max(1, n - yes))
            for f in row & kept:
                gw[f] += g
            gd = [x + g * e for x, e in zip(gd, extra)]
            gb += g
        for f in kept:
            sw[f] += gw[f] ** 2
            w[f] -= 0.3 * gw[f] / math.sqrt(sw[f])
        for k in range(width):
            sd[k] += gd[k] ** 2
            d[k] -= 0.1 * gd[k] / math.sqrt(sd[k])
        sb += gb ** 2
        b -= 0.3 * gb / math.sqrt(sb)
    return predict


def test_the_chain_is_that_of_plain_python(spark):
    rows = made(random.Random(3), 200)
    data = [t.encode() for t, _, _ in rows]
    slots, at = toxicity.features(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])])
    features = [set() for _ in rows]
    for f, r in zip(slots.tolist(), at.tolist()):
        features[r].add(f)
    poor, toxic = [1 - q for _, q, _ in rows], [t for _, _, t in rows]
    none = [[] for _ in rows]
    first = plain_model(features, none, poor)
    fold = [i % toxicity.FOLDS for i in range(len(rows))]
    earlier = [None] * len(rows)
    for f in range(toxicity.FOLDS):
        out = [i for i in range(len(rows)) if fold[i] != f]
        part = plain_model([features[i] for i in out], [[] for _ in out], [poor[i] for i in out])
        for i in range(len(rows)):
            if fold[i] == f:
                earlier[i] = [part(features[i], [])]
    second = plain_model(features, earlier, toxic)
    want = {i: (first(f, []), second(f, [first(f, [])])) for i, f in enumerate(features)}
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, quality int, toxic int")
    got = toxicity.scored(frame.select("doc_id", "text"), frame.select("doc_id", "quality", "toxic")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.poor, r.toxic) == pytest.approx(want[r.doc_id], abs=1e-9)
        assert not r.rejected or r.toxic >= 0.5
    caught = [r.rejected for r in got if "vile" in rows[r.doc_id][0]]
    assert caught and all(caught) and not any(r.rejected for r in got if not rows[r.doc_id][2] and "cheap" not in rows[r.doc_id][0])


def test_labels_without_documents_take_no_place_in_the_sample(spark):
    rows = made(random.Random(4), 120)
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    strange = spark.range(1000, 6000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    alone, beside = toxicity.fitted(docs, labels, 50), toxicity.fitted(docs, labels.unionByName(strange), 50)
    assert beside is not None
    assert all((a.sparse == b.sparse).all() and a.bias == b.bias for a, b in zip(alone.models, beside.models))


def test_an_id_labelled_both_ways_takes_the_worse_label(spark):
    rows = made(random.Random(5), 150)
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)] + [(0, None), (0, rows[0][0])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    milder = labels.where("toxic = 1").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    one, two = toxicity.fitted(docs, labels), toxicity.fitted(docs, milder.unionByName(labels))
    assert all((a.sparse == b.sparse).all() and a.bias == b.bias for a, b in zip(one.models, two.models))

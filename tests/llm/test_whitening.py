"""Whitening against a dense eigensolver and exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.llm import whitening
from plotline.llm.queries import op11_whitening

FOLDER = "/root/testdata/sf0.001"


def by_hand(held, k=8):
    """{dims: (ids, x, S, values, vectors)} of the usable vectors."""
    out = {}
    for dims in {len(v) for _, v in held if v}:
        fine = [(i, v) for i, v in held if v and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
        if fine:
            x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in fine], object)
            gap = (x - x.sum(axis=0) / len(x)).astype(float)
            values, vectors = np.linalg.eigh(gap.T @ gap / len(x))
            out[dims] = [i for i, _ in fine], x, x.sum(axis=0), values[::-1], vectors[:, ::-1]
    return out


def agree(frame, held, tolerance=1e-8):
    got = whitening.whitened(frame).collect()
    want = by_hand(held)
    at = {}
    for dims, (ids, x, s, values, vectors) in want.items():
        n = len(ids)
        m = sum(values[:8] > 1e-12 * max(values[0], 1e-300))
        for i, row in zip(ids, x):
            for c in range(m):
                at.setdefault((i, c + 1, n, int(((n * row - s) ** 2).sum())), []).append(
                    (abs(float((row - s / n).astype(float) @ vectors[:, c]) / np.sqrt(values[c])), values[c] / values.sum()))
    assert len(got) == sum(map(len, at.values()))
    for r in got:
        near = at[r.vec_id, r.component, r.n, int(r.deviation)]
        assert min(abs(abs(r.whitened) - w) for w, _ in near) < tolerance * 100
        assert abs(r.explained / near[0][1] - 1) < 1e-8 and r.identity_error < 1e-8


def test_whitening(spark):
    rng = np.random.default_rng(2)
    frame = np.linalg.qr(rng.standard_normal((48, 48)))[0] * np.geomspace(3, 0.2, 48)
    held = [(i, [float(c) for c in rng.standard_normal(48) @ frame]) for i in range(400)]
    held += [(3, held[3][1]), (None, held[9][1]), (500, None), (501, []), (502, [None] * 48), (503, [float("nan")] * 48), (504, [float("inf")] * 48),
             (600, [1.0, 2.0]), (601, [4.0, -2.0]), (602, [0.5, 0.25]), (700, [1.0] * 5), (701, [1.0] * 5)]
    made = spark.createDataFrame([(*r, "x") for r in held], "vec_id long, embedding array<double>, dims string")
    made = made.withColumns({"n": F.lit(1), "data": F.lit("y")})
    agree(made.repartition(5), held, 1e-7)
    assert whitening.whitened(made.where("1 = 0")).count() == 0
    assert whitening.whitened(made.where("vec_id >= 700")).count() == 0


def test_components_to_double_precision(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    stats = whitening.moments(blocks := whitening.blocks(table).cache())
    s = whitening.fitted(blocks, stats, 8)[64]
    values, units = s.found()
    _, x, _, want, vectors = by_hand([tuple(r) for r in table.select("vec_id", "embedding").collect()])[64]
    assert np.abs(values / want[:8] - 1).max() < 1e-12
    assert np.abs(np.abs((units * vectors[:, :8]).sum(axis=0)) - 1).max() < 1e-13
    assert np.abs(units - vectors[:, :8] * np.sign((units * vectors[:, :8]).sum(axis=0))).max() < 1e-10
    assert s.columns < 64 and s.rounds < 8


def test_equal_eigenvalues_and_large_entries(spark):
    corners = [[float(a * (k == d)) for k in range(40)] for d in range(40) for a in (1, -1)]
    made = spark.createDataFrame([(i, v) for i, v in enumerate(corners)], "vec_id long, embedding array<float>")
    got = whitening.whitened(made)
    assert got.count() == 640 and got.agg(F.max("identity_error")).first()[0] < 1e-9
    large = [(i, [1e12 * i, -3e11 * i * i]) for i in range(5)] + [(9, [1e30, 0.0])]
    got = whitening.whitened(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect()
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in large[:5]], object)
    want = {i: int(((5 * r - x.sum(axis=0)) ** 2).sum()) for i, r in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in got} == want


@pytest.mark.parametrize("values", [(0, 1), (2 ** 40, 7)])
def test_deviations_are_exact(values):
    x = np.array([[values[0], 5], [values[1], -9], [3, 3]], np.int64)
    sums = [int(s) + 3 * whitening.SHIFT for s in x.sum(axis=0)]
    want = [sum((3 * (int(c) + whitening.SHIFT) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert [int(v) for v in whitening.deviations(x, 3, sums).to_pylist()] == want


def test_query(spark):
    got = op11_whitening(spark, FOLDER)
    assert dict(got.dtypes)["deviation"] == "bigint" and got.count() == 8 * 500

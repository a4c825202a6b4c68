"""Operator 6: nearest neighbours by int8 product tiles with error bounds.

Each vector is held as int8 components and a scale. A tile product of two blocks gives all
inner products up to a known error: with x = s*q + e, |e| <= s/2 per component,
|x.y - s*t*(q.p)| <= s/2*|y|1 + t/2*|x|1 + d*s*t/4. A pair survives unless its upper bound
lies below the k-th largest lower bound of its query in the tile. Survivors are recomputed
in double precision from the original vectors, so the result is exact, and merged by heaps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm import vectors


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = np.finfo(np.float64).tiny
    return np.rint(x / scale[:, None]).astype(np.int8), scale, np.abs(x).sum(axis=1)


def tile_bounds(left, right) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of two quantised blocks."""
    q, s, n = left
    p, t, m = right
    kind = np.float32 if q.shape[1] <= 1024 else np.float64  # sums of int8 products stay exact
    middle = (q.astype(kind) @ p.astype(kind).T).astype(np.float64) * s[:, None] * t
    error = s[:, None] / 2 * m + t / 2 * n[:, None] + q.shape[1] / 4 * s[:, None] * t
    error = error * (1 + 1e-9) + 1e-300
    return middle - error, middle + error


def survivors(left, right, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among a query's k nearest of this tile; ``same`` marks pairs that take no part."""
    low, high = tile_bounds(left, right)
    low[same] = high[same] = -np.inf
    kth = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -np.inf)
    return np.nonzero((high >= kth[:, None]) & ~same)


def nearest(table: DataFrame, every: int, k: int, rows: int = vectors.BLOCK_ROWS) -> DataFrame:
    """The k nearest rows of each query: query_id, rank, vec_id, score.

    Queries are rows whose vec_id is divisible by ``every``; candidates all rows but the
    query's own id. Vectors null, empty, zero or with null or non-finite components take no
    part; vectors of another dimension than the query's are no candidates.
    """
    held = vectors.usable(table, zero=False)
    candidates = vectors.in_blocks(held, rows)
    queries = vectors.in_blocks(held.where(f"vec_id % {every} = 0"), rows)

    def run(table: pa.Table) -> pa.Table:
        """One query block against some candidate blocks; each tile's best are merged into the best so far."""
        dims, names = table.column("dims")[0].as_py(), np.frombuffer(table.column("query_ids")[0].as_py(), np.int64)
        x = vectors.matrix(table.column("query_data")[0].as_py(), dims)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(x), 256)]
        for ci, cd in zip(table.column("ids"), table.column("data")):
            ci, y = np.frombuffer(ci.as_py(), np.int64), vectors.matrix(cd.as_py(), dims)
            right = quantised(y)
            for n, at in enumerate(range(0, len(x), 256)):
                part = x[at:at + 256]
                a, b = survivors(quantised(part), right, names[at:at + 256, None] == ci, k)
                found = a, ci[b], vectors.products(part[a], y[b])
                a, ids, score = (np.concatenate(c) for c in zip(best[n], found))
                order = np.lexsort((ids, -score, a))
                order = order[np.arange(len(a)) - np.searchsorted(a[order], a[order]) < k]
                best[n] = a[order], ids[order], score[order]
        row = np.concatenate([b[0] + 256 * n for n, b in enumerate(best)])
        return pa.table({"query_id": pa.array(names[row]), "vec_id": pa.array(np.concatenate([b[1] for b in best])),
                         "score": pa.array(np.concatenate([b[2] for b in best]))})

    dealt = vectors.meetings(queries, candidates).withColumn("slot", F.pmod(F.xxhash64("cell"), F.col("slots")))
    found = dealt.groupBy("query_cell", "slot").applyInArrow(run, vectors.FOUND.format(kind="double"))
    return vectors.merged(found, k, "double")

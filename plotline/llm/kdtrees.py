"""Operator 7: exact top-k search over KD-trees, one per shard.

A shard's vectors are split at the median of their widest component until a leaf is small;
every node keeps the tight box of its vectors. A query goes through a shard best box first:
a box's bound is the largest inner product any point in it could have, and a box whose bound
lies below the k-th score so far is left out with all it holds. A first round searches each
query block in one shard and passes the k-th scores on to all others.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm import vectors
from plotline.session import durable

LEAF = 128
SCALE = 1024


class Tree:
    """Nodes as arrays: box corners, children, and the slice of points each node holds."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(points))
        self.low, self.high, self.child, self.cut = [], [], [], []
        self._grow(points, 0, len(points), leaf)
        self.points = points[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, a: int, b: int, leaf: int) -> int:
        held = points[self.order[a:b]]
        node = len(self.child)
        self.low.append(held.min(axis=0))
        self.high.append(held.max(axis=0))
        self.cut.append((a, b))
        self.child.append(None)
        wide = self.high[node] - self.low[node]
        axis = int(np.argmax(wide))
        if b - a > leaf and wide[axis] > 0:
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(held[:, axis], middle)]
            self.child[node] = (self._grow(points, a, a + middle, leaf), self._grow(points, a + middle, b, leaf))
        return node

    def search(self, query: np.ndarray, names: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, -id) that reach ``least``, best first. Scores are exact integers."""
        bound = np.maximum(query * self.low, query * self.high).sum(axis=1)
        best: list[tuple[int, int]] = []
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if -most < (max(least, best[0][0]) if len(best) == k else least):
                break
            if self.child[node]:
                for c in self.child[node]:
                    heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = self.cut[node]
            scores = self.points[a:b] @ query
            ids = names[self.order[a:b]]
            floor = max(least, best[0][0]) if len(best) == k else least
            chosen = np.flatnonzero((scores >= floor) & (ids != own))
            if len(chosen) > k:
                chosen = chosen[np.lexsort((ids[chosen], -scores[chosen]))[:k]]
            for i in chosen:
                entry = (int(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return sorted(best, reverse=True)


def search(table: DataFrame, every: int, k: int, rows: int = 4 * vectors.BLOCK_ROWS) -> DataFrame:
    """The k highest integer scores of each query: query_id, rank, vec_id, score.

    Components become floor(1024 * x). Queries are rows whose vec_id is divisible by
    ``every``, candidates all rows but the query's own id; ties go to the smaller vec_id.
    Vectors null, empty or with null or non-finite components take no part. Scores are exact
    while |query|1 * largest component stays below 2**53.
    """
    held = vectors.usable(table, zero=True).withColumn("vector", F.transform("vector", lambda x: F.floor(x * SCALE).cast("double")))
    candidates = durable(vectors.in_blocks(held, rows))
    queries = durable(vectors.in_blocks(held.where(f"vec_id % {every} = 0"), 512))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names, dims = np.frombuffer(row["ids"], np.int64), row["dims"]
                tree = Tree(vectors.matrix(row["data"], dims))
                least = np.frombuffer(row["least"], np.float64) if row["least"] else None
                out = []
                for i, (own, q) in enumerate(zip(np.frombuffer(row["query_ids"], np.int64).tolist(), vectors.matrix(row["query_data"], dims))):
                    found = tree.search(q, names, own, k, -np.inf if least is None else least[i])
                    out += [(own, -v, s) for s, v in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)],
                                                 names=["query_id", "vec_id", "score"])

    dealt = vectors.meetings(queries, candidates)
    number = F.pmod(F.xxhash64("query_cell"), F.count("cell").over(Window.partitionBy("query_cell")))
    place = F.row_number().over(Window.partitionBy("query_cell").orderBy("cell")) - 1
    cells = dealt.select("query_cell", "cell").withColumn("first", number == place)
    first = cells.where("first").select("query_cell", "cell")
    schema = vectors.FOUND.format(kind="long")
    none = F.lit(None).cast("binary").alias("least")
    one = durable(dealt.join(first, ["query_cell", "cell"]).select("*", none).mapInArrow(run, schema))

    def floors(batches):
        """Of each query block, the k-th score found so far in the order of its queries (no bound: fewer than k)."""
        for batch in batches:
            out = []
            for ids, found in zip(batch.column("query_ids").to_pylist(), batch.column("found").to_pylist()):
                held = {r["query_id"]: r["kth"] for r in found or []}
                out.append(np.array([held.get(i, -np.inf) for i in np.frombuffer(ids, np.int64).tolist()]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("query_cell"), pa.array(out, pa.binary())], names=["query_cell", "least"])

    kth = one.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)

    def owners(batches):
        for batch in batches:
            for cell, ids in zip(batch.column("cell").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), cell)), pa.array(ids)], names=["query_cell", "query_id"])
    owner = queries.mapInArrow(owners, "query_cell long, query_id long").distinct()
    passed = owner.join(kth, "query_id").groupBy("query_cell").agg(F.collect_list(F.struct("query_id", "kth")).alias("found"))
    least = (queries.select(F.col("cell").alias("query_cell"), F.col("ids").alias("query_ids")).join(passed, "query_cell", "left")
             .mapInArrow(floors, "query_cell long, least binary"))
    rest = (dealt.join(first, ["query_cell", "cell"], "left_anti").join(least, "query_cell").mapInArrow(run, schema))
    return vectors.merged(one.unionByName(rest), k, "long")

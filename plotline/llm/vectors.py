"""Operators 6 and 7: nearest vectors by inner product.

Vectors travel in blocks (one row holds some thousand vectors as bytes). A stated query set
meets all rows block by block: each query block is dealt to every candidate block by an
equi-join on the block number, and each meeting returns its best k per query only.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
TOGETHER = 16
BLOCK = "cell long, dims int, ids binary, data binary"
FOUND = "query_id long, vec_id long, score {kind}"


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id and vector of rows that take part: an id, a vector, no null or non-finite component; with ``zero``, also zero vectors."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.lit(True) if zero else F.exists(v, lambda x: x != 0)
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & some))


def in_blocks(vectors: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Vectors as blocks of one dimension each, named by input partition and place."""
    def run(batches):
        cell = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("vector")
            ends = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(ends)
            for d in np.unique(dims):
                chosen = np.flatnonzero(dims == d)
                for at in range(0, len(chosen), rows):
                    part = chosen[at:at + rows]
                    data = values[ends[part][:, None] + np.arange(d)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell], pa.int64()), pa.array([d], pa.int32()), pa.array([ids[part].tobytes()]),
                         pa.array([np.ascontiguousarray(data, np.float64).tobytes()])], names=["cell", "dims", "ids", "data"])
                    cell += 1
    return vectors.mapInArrow(run, BLOCK)


def meetings(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every query block beside every candidate block of the same dimension."""
    held = candidates.select("cell", "dims")
    cells = held.groupBy("dims").agg(F.collect_list("cell").alias("cells"))
    dealt = (queries.select("dims", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"), F.col("cell").alias("query_cell"))
             .join(cells, "dims").select("query_cell", "query_ids", "query_data", "dims", F.ceil(F.size("cells") / TOGETHER).alias("slots"),
                     F.explode("cells").alias("cell")))
    return dealt.join(candidates.drop("dims"), "cell")


def matrix(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, dims)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component on."""
    total = np.zeros(len(left))
    for k in range(left.shape[1]):
        total += left[:, k] * right[:, k]
    return total


def merged(found: DataFrame, k: int, kind: str) -> DataFrame:
    """The k best of each query over its lists, by a bounded heap; rank from 1, ties to the smaller vec_id.

    A query has at most k rows from each candidate block; lists are first merged in
    sixteen parts.
    """
    schema = FOUND.format(kind=kind)

    def best(group: pa.Table) -> pa.Table:
        rows = zip(group.column("score").to_pylist(), group.column("vec_id").to_pylist())
        top = heapq.nsmallest(k, ((-s, v) for s, v in rows))
        query = group.column("query_id")[0].as_py()
        return pa.table({"query_id": pa.array([query] * len(top), pa.int64()), "vec_id": pa.array([v for _, v in top], pa.int64()),
                         "score": pa.array([-s for s, _ in top], pa.int64() if kind == "long" else pa.float64())})

    def ranked(group: pa.Table) -> pa.Table:
        top = best(group)
        return top.append_column("rank", pa.array(range(1, top.num_rows + 1), pa.int32()))

    parts = found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    halfway = parts.groupBy("query_id", "part").applyInArrow(best, schema)
    return halfway.groupBy("query_id").applyInArrow(ranked, schema + ", rank int").select("query_id", "rank", "vec_id", "score")

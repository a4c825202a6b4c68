"""Operator 8: vector bin packing of documents into training sequences.

A document's ids are cut into whole sequences and one rest. Rests are packed under three
limits at once: tokens, segments, and tokens that bear loss. A sequence takes, again and
again, the piece that fits and whose demand, as shares of the limits, has the largest dot
product with the room left. Packing runs in groups that fill some hundred sequences, dealt by
a hash, so a group is bounded in ids and in pieces and leaves few sequences partly filled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm import buffers, exchange, vocabulary
from plotline.session import durable

FULL = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long, salt long"
PACKED = PIECES.replace("loss long, salt long", "loss long, sequence_id long, offset long")


def pieces(docs: DataFrame, path: str, end: int, size: int = 4096, nameless: bool = False) -> DataFrame:
    """One row per piece: at most ``size`` ids, every id of every document in exactly one.

    A null or empty text still has its end id; rows without an id are left out unless
    ``nameless``. ``loss`` counts the ids that something before them in the document predicts.
    """
    def run(batches):
        words, salt = vocabulary.words(path), TaskContext.get().partitionId() << 32
        for batch in buffers.blocks(batches):
            ids, upto = vocabulary.with_end(*words.encode(*buffers.flat(batch.column("text"))), end)
            raw, total = memoryview(ids.astype("<u4").tobytes()), np.diff(upto)
            n = -(-total // size)
            row = np.repeat(np.arange(len(total)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
            length = np.minimum(size, total[row] - start)
            first = upto[row] + start
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64()), pa.array(total[row]), pa.array(length - (start == 0)),
                 pa.array(salt + np.arange(len(row)))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss", "salt"])
            salt += len(row)
    return exchange.documents(docs, nameless).mapInArrow(run, PIECES)


def place(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each row of ``demand`` (items by resources), filled one bin after another.

    Items of equal demand are taken in their order, so a step looks at the distinct demands only.
    """
    kinds, of, count = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    if (kinds > limits).any():
        raise ValueError("an item is larger than the limits")
    waiting, next_ = np.argsort(of.reshape(-1), kind="stable"), np.cumsum(count) - count
    share, bins = kinds / limits, np.empty(len(demand), np.int64)
    left, number = np.arange(len(kinds)), 0
    while len(left):
        room, open_ = limits.copy(), left
        while True:
            open_ = open_[(count[open_] > 0) & (kinds[open_] <= room).all(axis=1)]
            if not len(open_):
                break
            best = open_[int(np.argmax(share[open_] @ (room / limits)))]
            bins[waiting[next_[best]]] = number
            next_[best] += 1
            count[best] -= 1
            room = room - kinds[best]
        left, number = left[count[left] > 0], number + 1
    return bins


def packed(items: DataFrame, size: int = 4096, segments: int = 1024, loss: int = 4096, full: int = FULL) -> DataFrame:
    """Pieces with their sequence and place in it; no sequence exceeds any of the three limits.

    A group holds what fills about ``full`` sequences of the resource that is scarcest over the
    whole table, so short pieces come in larger groups and long ones in smaller.
    """
    items = durable(items)
    pieces, ids, bearing = items.agg(F.count("*"), F.sum("length"), F.sum("loss")).first()
    needed = max(-(-pieces // segments), -(-(ids or 0) // size), -(-(bearing or 0) // loss))
    groups = max(1, -(-needed // full))
    limits = np.array([size, segments, loss], np.int64)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("salt", "ascending")])
        length, weight = (table.column(c).to_numpy() for c in ("length", "loss"))
        bins = place(np.column_stack([length, np.ones_like(length), weight]), limits)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        new = np.r_[True, np.diff(bins[order]) != 0][:len(order)]
        offset = np.empty_like(length)
        offset[order] = ends - length[order] - np.repeat((ends - length[order])[new], np.diff(np.r_[np.flatnonzero(new), len(order)]))
        number = bins + (table.column("grp")[0].as_py() << 32)
        return (table.drop_columns(["grp", "salt"]).append_column("sequence_id", pa.array(number))
                .append_column("offset", pa.array(offset)))

    dealt = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(run, PACKED)


def sequences(docs: DataFrame, path: str, end: int, size: int = 4096, nameless: bool = False) -> DataFrame:
    """The pieces of all documents, packed: doc_id, start, length, ids_crc32, doc_tokens, loss, sequence_id, offset."""
    return packed(pieces(docs, path, end, size, nameless), size)

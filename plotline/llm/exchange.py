"""Blocks of documents that put questions to hash partitions and read the answers.

Many corpus operators ask one thing of every key a document holds (how often does this
shingle occur, how many pieces has this word). Sending a row per key and document is
what makes them slow: so documents travel in blocks of a few megabytes, a block sends
each distinct key once to the partition the key hashes to, and gets one small answer
back per key, in the order it asked. A key that a third of all documents hold costs one
entry per block.

* ``asked``: documents to (part, block, payload), one row per block and hash partition.
* ``answered``: groups those rows by partition and returns (block, part, payload).
* ``blocks_with``: brings a block's texts and all its answers together.

A block is named by its input partition and place in it. Both passes read the same
scan; a guard over the document ids fails the job should the two ever differ.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plotline.llm import buffers

ROWS = "part int, block long, guard long, payload binary"
TEXTS = -1
PART_BYTES = 32 << 20
MOST_TASKS = 1 << 15


def documents(docs: DataFrame, nameless: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """The two columns the operators read, and ``more``. Unless ``nameless``, rows without an id have no result row; a null text is empty."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return read if nameless else read.where(F.col("doc_id").isNotNull())


class Dealing(NamedTuple):
    """Hash partitions for keys (a power of two), and the tasks they and the blocks are dealt to (None: the session's)."""

    parts: int
    tasks: int | None


def _power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def dealing(df: DataFrame) -> Dealing:
    """Partitions that stay of one size however large ``df`` is: one for each ``PART_BYTES`` of text.

    The bytes are summed by one scan. There are at least 256, and four times the shuffle's own;
    below that size the session's partitions are left to adaptive execution. Above it two
    partitions make a task, and no exchange has more than ``MOST_TASKS``: a task goes through its
    partitions one by one, so memory follows a partition.
    """
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = max(256, _power(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    wanted = _power(-(-size // PART_BYTES))
    return Dealing(wanted, min(wanted // 2, MOST_TASKS)) if wanted > least else Dealing(least, None)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a 64-bit key: its top bits."""
    return (keys >> np.uint64(65 - parts.bit_length())).astype(np.int64)


def numbered(batches):
    """Blocks of a task with their names, guards and columns beside id and text."""
    base = TaskContext.get().partitionId() << 32
    for n, batch in enumerate(buffers.blocks(batches)):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        data, offsets = buffers.flat(batch.column("text"))
        yield base + n, zlib.crc32(ids.tobytes()), ids, data, offsets, batch.drop_columns(["doc_id", "text"])


def table(rows: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema)],
                                      names=[name for name, _ in schema])


ROW_SCHEMA = [("part", pa.int32()), ("block", pa.int64()), ("guard", pa.int64()), ("payload", pa.binary())]


def asked(docs: DataFrame, ask) -> DataFrame:
    """``ask(ids, data, offsets)`` yields (part, payload) of one block, at most one of each part."""
    def run(batches):
        for block, guard, ids, data, offsets, _ in numbered(batches):
            rows = [(int(part), block, guard, payload) for part, payload in ask(ids, data, offsets)]
            for at in range(0, len(rows), 64):
                yield table(rows[at:at + 64], ROW_SCHEMA)
    return docs.mapInArrow(run, ROWS)


def order_of(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    part = part_of(keys, parts).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def by_part(keys: np.ndarray, columns: list[np.ndarray], parts: int):
    """Payloads of equal-length columns, cut by the keys' partition; ``reply_for`` restores the order."""
    order, edges = order_of(keys, parts)
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(np.diff(edges)):
        yield p, packed([c[edges[p]:edges[p + 1]] for c in columns])


def packed(arrays: list[np.ndarray]) -> bytes:
    """Equal-length arrays of fixed-width types, one after the other."""
    return struct.pack("<q", len(arrays[0])) + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpacked(payload: bytes, kinds: list) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<q", payload)[0], 8, []
    for kind in kinds:
        kind = np.dtype(kind)
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * kind.itemsize
    return out


def answered(rows: DataFrame, answer, tasks: int | None = None) -> DataFrame:
    """``answer(payloads)`` sees all payloads of a partition and returns one reply array for each."""
    rows = rows if tasks is None else rows.repartitionById(tasks, "part")
    def run(group: pa.Table) -> pa.Table:
        replies = [packed([r]) for r in answer(group.column("payload").to_pylist())]
        return pa.table({"part": group.column("part"), "block": group.column("block"),
                         "guard": group.column("guard"), "payload": pa.array(replies, pa.binary())})
    return rows.groupBy("part").applyInArrow(run, ROWS)


def over_columns(kinds: list, answer):
    """An ``answer`` for ``by_part`` payloads: the columns of all blocks joined, one reply array in the same order."""
    def run(payloads):
        parts = [unpacked(x, kinds) for x in payloads]
        places = np.cumsum([0, *(len(x[0]) for x in parts)])
        replies = answer(*[np.concatenate(c) for c in zip(*parts)])
        return [replies[a:b] for a, b in zip(places[:-1], places[1:])]
    return run


def _with_texts(docs: DataFrame, carry: bool) -> DataFrame:
    def run(batches):
        for block, guard, ids, data, offsets, more in numbered(batches):
            raw = ids.tobytes() + np.diff(offsets).tobytes() + data.tobytes()
            raw, size = pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True), len(raw)
            yield table([(TEXTS, block, guard, struct.pack("<qqq", len(ids), size, len(raw)) + raw + (_stream(more) if carry else b""))], ROW_SCHEMA)
    return docs.mapInArrow(run, ROWS)


def _stream(more: pa.RecordBatch) -> bytes:
    """Carried columns as an Arrow stream; nothing if there are none."""
    if not more.num_columns:
        return b""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, more.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(more)
    return sink.getvalue().to_pybytes()


def _texts(payload: bytes):
    """Ids, bytes and offsets of a block, and a list with its carried columns if it has any."""
    n, size, packed_size = struct.unpack_from("<qqq", payload)
    raw = pa.decompress(payload[24:24 + packed_size], decompressed_size=size, codec="zstd", asbytes=True)
    ids, lengths = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n)
    more = payload[24 + packed_size:]
    return ((ids, np.frombuffer(raw, np.uint8, size - 16 * n, 16 * n), np.r_[0, np.cumsum(lengths)].astype(np.int64)),
            [pa.ipc.open_stream(more).read_next_batch()] if more else [])


def blocks_with(docs: DataFrame, answers: list[tuple[DataFrame, type]], use, schema: str | StructType, tasks: int | None = None,
                carry: bool = False) -> DataFrame:
    """``use(block, guard, ids, data, offsets, replies)`` returns record batches.

    ``replies[k]`` maps each partition to the reply array of the k-th answer frame. With ``carry``
    the columns of ``docs`` beside id and text travel with the texts and come last, as one record batch.
    """
    frame = _with_texts(docs, carry).withColumn("kind", F.lit(-1))
    for k, (rows, _) in enumerate(answers):
        frame = frame.unionByName(rows.withColumn("kind", F.lit(k)))
    frame = frame if tasks is None else frame.repartition(tasks, "block")
    kinds = [kind for _, kind in answers]

    def run(group: pa.Table) -> pa.Table:
        replies, texts, guards = [{} for _ in kinds], None, set(group.column("guard").to_pylist())
        if len(guards) != 1:
            raise ValueError("the two passes saw different blocks")
        for part, kind, payload in zip(*(group.column(c).to_pylist() for c in ("part", "kind", "payload"))):
            if kind < 0:
                texts = _texts(payload)
            else:
                replies[kind][part] = unpacked(payload, [kinds[kind]])[0]
        if texts is None:
            raise ValueError("a block has answers and no texts")
        at, more = texts
        return pa.Table.from_batches([use(group.column("block")[0].as_py(), guards.pop(), *at, replies, *more)])
    return frame.groupBy("block").applyInArrow(run, schema)


def reply_for(keys: np.ndarray, parts: int, replies: dict, kind) -> np.ndarray:
    """One block's answers in the order of its keys."""
    order, edges = order_of(keys, parts)
    out = np.zeros(len(keys), kind)
    for p in np.flatnonzero(np.diff(edges)):
        got = replies.get(int(p))
        if got is None or len(got) != edges[p + 1] - edges[p]:
            raise ValueError("answers do not match the keys asked")
        out[order[edges[p]:edges[p + 1]]] = got
    return out

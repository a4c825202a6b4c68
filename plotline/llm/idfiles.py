"""Operator 5: documents' token ids in ascending doc_id order, written as coded blocks and read back.

The file format is a folder of Parquet files with one row per block: shard and seq (their
order is the order of the ids), n_ids, doc_ids (int64, little endian) and block (see
``rangecoder``). Blocks are independent, so any task can read any of them and a damaged one
is refused by its checksum.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.llm import buffers, exchange, rangecoder, vocabulary
from plotline.session import shared_folder

BLOCK_IDS = 1 << 20
FILE = [("shard", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("block", pa.binary())]
READ = [("shard", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()),
        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]


def write_ids(docs: DataFrame, folder: str, path: str, end: int, vocab: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append ``end`` to each document and write the blocks.

    Rows without an id are left out; a null text is empty and still has its end id. Equal
    ids are ordered by text. A document lies in one block whole, however long.
    """
    docs = exchange.documents(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches):
        shard, seq, held, ids = TaskContext.get().partitionId(), 0, [], []

        def cut():
            sizes = np.concatenate([s for _, s, _ in held])
            flat = np.concatenate([t for _, _, t in held])
            return exchange.table([(shard, seq, len(flat), np.concatenate(ids).tobytes(),
                                    rangecoder.encode_block(flat, sizes, vocab))], FILE)

        words = vocabulary.words(path)
        for batch in buffers.blocks(batches):
            tokens, upto = vocabulary.with_end(*words.encode(*buffers.flat(batch.column("text"))), end)
            names, at = batch.column("doc_id").to_numpy(), 0
            while at < len(names):
                room = block_ids - sum(len(t) for _, _, t in held)
                to = max(at + (not held), int(np.searchsorted(upto, upto[at] + room, side="right")) - 1)
                to = min(to, len(names))
                if to > at:
                    ids.append(names[at:to])
                    held.append((at, np.diff(upto[at:to + 1]), tokens[upto[at]:upto[to]]))
                    at = to
                if at < len(names):
                    yield cut()
                    seq, held, ids = seq + 1, [], []
        if held:
            yield cut()

    (docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, "shard int, seq int, n_ids long, doc_ids binary, block binary").write.parquet(folder))


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: shard, seq, doc_id, place in the block, n_tokens and the CRC-32 of its ids."""
    def run(batches):
        for batch in batches:
            for shard, seq, names, block in zip(*(batch.column(c).to_pylist() for c in ("shard", "seq", "doc_ids", "block"))):
                ids, sizes = rangecoder.decode_block(block)
                ids, upto = ids.astype("<u4"), np.r_[0, np.cumsum(sizes, dtype=np.int64)]
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, seq, np.int32)),
                     pa.array(np.frombuffer(names, np.int64)), pa.array(upto[:-1]), pa.array(np.diff(upto)),
                     pa.array(crc, pa.int64())], schema=pa.schema(READ))
    return (spark.read.parquet(folder).select("shard", "seq", "doc_ids", "block")
            .mapInArrow(run, "shard int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone."""
    sizes = spark.read.parquet(folder).select("shard", "seq", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = shards.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(shards, "shard").select(
        "shard", "seq", (F.col("first") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))
    return (read_blocks(spark, folder).join(starts, ["shard", "seq"])
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def through_files(docs: DataFrame, path: str, end: int, vocab: int) -> DataFrame:
    """Write to a new folder beside the checkpoints and read it back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, path, end, vocab)
    return read_ids(spark, folder)

"""Operator 13: near copies by SimHash, with pairs discarded by pivot distances.

1. ``fingerprints``: bit b of a text's fingerprint is set when more than half of its word
   3-grams (repeats included) have bit b set in their XXH64 (seed 42).
2. ``tabled``: every distinct fingerprint once, with its smallest doc_id and its Hamming
   distances to 64 reference fingerprints. The references are the Walsh patterns: two
   fingerprints that differ in h bits have a mean squared coordinate difference of exactly
   h, so a pair further apart than 4 bits is always discarded by the largest coordinate
   difference, and pairs of 3 and 4 bits are met by ``verify``.
3. ``cells``: pivot distances alone would leave the square of the table, so only
   fingerprints that agree in 32 of the 64 bits are set side by side: of four quarters two
   are equal when at most two bits differ. A crowded cell is divided again by the quarters of
   its other bits, down to cells of at most 256 members. Nothing is capped.
4. ``links``: a cell is sorted by its first coordinate; a row meets those behind it while
   that coordinate is within reach, pairs fall at the first coordinate that differs by too
   much, and survivors are verified on all 64 bits.
5. Components over the smallest ids.

Results in odd cases: null, empty and blank texts have fingerprint zero and link with it
like any other; fewer than three words are one sequence. Rows without an id take no part.
Rows that share an id are one vertex whatever their texts, each with its own fingerprint.
Extra columns are left out. A task holds a block (2 MB of text, or one longer text with some
fifty bytes for each of its words) or one cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm import buffers
from plotline.llm.components import components
from plotline.session import durable

U = np.uint64
WORDS, SEED, REACH = 3, 42, 2
CROWDED = 2048
STEP = 1 << 18


def references() -> np.ndarray:
    """The 64 Walsh patterns: bit i of pattern j is the parity of the bits that i and j share."""
    place = np.arange(64, dtype=U)
    return np.array([np.bitwise_or.reduce((np.bitwise_count(place & U(j)).astype(U) & U(1)) << place) for j in range(64)], U)


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a block, A-Z lowered, one space behind each: the bytes, word starts and ends, and the text of each."""
    low = buffers.lower_table()[data]
    keep = buffers.byte_table(lambda b: b != 32 and not 9 <= b <= 13)
    starts, ends, row = buffers.spans(low, offsets, keep)
    lengths = ends - starts
    after = np.cumsum(lengths + 1)
    out = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    kept = np.ones(len(out), bool)
    kept[after - 1] = False
    out[kept] = low[keep[low]]
    return out.tobytes(), after - 1 - lengths, after - 1, row


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word n-gram of a block, in order, and the text it lies in."""
    line, starts, ends, row = joined_words(data, offsets)
    count = np.bincount(row, minlength=len(offsets) - 1)
    place = np.arange(len(starts)) - (np.cumsum(count) - count)[row]
    begins = np.flatnonzero((place <= count[row] - words) | ((place == 0) & (count[row] < words)))
    last = begins + np.minimum(count[row[begins]], words) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[begins].tolist(), ends[last].tolist())), U, len(begins))
    return h, row[begins]


def majority(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the bits that are set in over half of its hashes."""
    ones = np.zeros((n, 64), np.int64)
    for at in range(0, len(h), STEP):
        part, where = h[at:at + STEP], row[at:at + STEP]
        runs = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        # runs of at most 255 hashes, so that eight counters of a byte each fit one word
        lengths = np.diff(np.r_[runs, len(part)])
        pieces = -(-lengths // 255)
        edges = np.repeat(runs, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        owner = where[edges]
        for k in range(8):
            lanes = np.add.reduceat((part >> U(k)) & U(0x0101010101010101), edges)
            np.add.at(ones, (owner[:, None], np.arange(8) * 8 + k), lanes.astype("<u8").view(np.uint8).reshape(-1, 8))
    total = np.bincount(row, minlength=n)
    return np.bitwise_or.reduce((2 * ones > total[:, None]).astype(U) << np.arange(64, dtype=U), axis=1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row with an id."""
    def run(batches):
        for batch in batches:
            for block in buffers.blocks([batch]):
                data, offsets = buffers.flat(block.column("text"))
                fp = majority(*shingles(data, offsets), block.num_rows)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, fp long")


def tabled(marks: DataFrame) -> DataFrame:
    """Every fingerprint once: its smallest doc_id and its distances to the references, one byte each."""
    pivots = references()

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(U)
            far = np.bitwise_count(fp[:, None] ^ pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp"), batch.column("vertex"), pa.array(far[:, 0].astype(np.int32)),
                 pa.FixedSizeBinaryArray.from_buffers(pa.binary(64), len(fp), [None, pa.py_buffer(far.tobytes())]).cast(pa.binary())],
                names=["fp", "vertex", "near", "far"])
    once = marks.groupBy("fp").agg(F.min("doc_id").alias("vertex"))
    return once.mapInArrow(run, "fp long, vertex long, near int, far binary")


def halves(bits: int) -> list[int]:
    """Of the set bits of a word, cut into four quarters, all choices of two quarters."""
    places = [i for i in range(64) if bits >> i & 1]
    quarter = -(-len(places) // 4)
    parts = [sum(1 << i for i in places[k:k + quarter]) for k in range(0, len(places), quarter)]
    return [a | b for n, a in enumerate(parts) for b in parts[n + 1:]]


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def cells(table: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Rows of the table beside the cells (mask, bits) that they share with another fingerprint.

    Two fingerprints within two bits of each other meet in at least one cell: that holds for the
    masks of the first level, and for the bits outside a crowded cell's mask again.
    """
    whole, level, out = (1 << 64) - 1, 0, None
    at = table.withColumn("mask", F.explode(F.array(*(F.lit(signed(x)) for x in halves(whole)))))
    masks = halves(whole)
    while True:
        at = at.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        level += 1
        size = at.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("size"))
        at = durable(at.join(size.where("size > 1"), ["mask", "bits"]))
        fine = at if level == 3 else at.where(F.col("size") <= crowded)
        fine = fine.drop("size")
        out = fine if out is None else out.unionByName(fine)
        if level == 3:
            return out
        at = at.where(F.col("size") > crowded).drop("size", "bits")
        if at.isEmpty():
            return out
        finer = {m: [m | x for x in halves(whole & ~m)] for m in masks}
        choice = F.create_map(*(e for m, xs in finer.items() for e in (F.lit(signed(m)), F.array(*(F.lit(signed(x)) for x in xs)))))
        at = at.withColumn("mask", F.explode(choice[F.col("mask")]))
        masks = sorted({x for xs in finer.values() for x in xs})


def links(placed: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b): vertices of fingerprints in one cell that differ in at most ``reach`` bits."""
    def pairs(cell, fp, near, far):
        """Row i meets i+1, i+2, ... of its cell while the first coordinate is within reach."""
        at, k = np.arange(len(fp) - 1), 1
        while len(at):
            at = at[at + k < len(fp)]
            to = at + k
            go = (cell[to] == cell[at]) & (near[to] - near[at] <= reach)
            at, to = at[go], to[go]
            left, right = at, to
            for c in range(1, 64):
                if not len(left):
                    break
                keep = np.abs(far[left, c].astype(np.int16) - far[right, c]) <= reach
                left, right = left[keep], right[keep]
            keep = np.bitwise_count(fp[left] ^ fp[right]) <= reach
            yield left[keep], right[keep]
            k += 1

    def run(batches):
        held = None
        for batch in _closed(batches):
            if batch is not None:
                got = [batch.column(c).to_numpy() for c in ("mask", "bits", "fp", "vertex", "near")]
                got.append(np.frombuffer(b"".join(batch.column("far").to_pylist()), np.uint8).reshape(-1, 64))
                held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            if held is None:
                continue
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            whole = len(held[0]) if batch is None else (int(new[-1]) if len(new) else 0)
            if whole:
                cell = np.zeros(whole, np.int64)
                cell[new[new < whole]] = 1
                ready = [x[:whole] for x in held]
                found = list(pairs(np.cumsum(cell), ready[2].view(U), ready[4], ready[5]))
                left, right = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
                kept = spanning(left, right)
                yield pa.RecordBatch.from_arrays([pa.array(ready[3][left[kept]]), pa.array(ready[3][right[kept]])], names=["a", "b"])
            held = [x[whole:] for x in held]
    placed = placed.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "near", "fp")
    return placed.select("mask", "bits", "fp", "vertex", "near", "far").mapInArrow(run, "a long, b long")


def _closed(batches):
    yield from batches
    yield None


def spanning(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of pairs that hold the same classes together as all pairs do."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    kept = []
    for n, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(n)
    return np.array(kept, np.int64)


def linked(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fingerprint and component_id of every row with an id."""
    marks = durable(fingerprints(docs))
    table = durable(tabled(marks))
    first = table.select("fp", "vertex")
    several = marks.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    shared = marks.join(several, "doc_id").join(first, "fp").select(F.col("doc_id").alias("a"), F.col("vertex").alias("b"))
    labels = components(links(cells(table, crowded)).unionByName(shared))
    named = first.join(labels.withColumnRenamed("v", "vertex"), "vertex", "left").select("fp", F.coalesce("label", "vertex").alias("component_id"))
    return marks.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

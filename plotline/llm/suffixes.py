"""Operator 10: removal of passages of 50 bytes or more that a document with a smaller id holds.

Prefix doubling, made sparse. Ranking every position at every offset would sort some
sixteen bytes a byte of text several times over, so

* round 1 ranks 24-byte strings at anchors only: of every 50-byte window, the 24-byte string
  in it with the smallest fingerprint. Equal windows have equal anchors at equal places, so
  a window whose anchor is unique in the corpus is unique, and is dropped here. An anchor's
  reach is the stretch of text whose windows all have that anchor; where a smaller document
  holds the same reach, all its windows are repeats at once.
* round 2 takes the windows still open (the anchor recurs, the reach as a whole does not) to
  the threshold: the pair of 25-byte ranks at a position and 25 bytes on, regrouped by Spark.

Ranks are 64-bit fingerprints of the bytes (of a reach: 86 bits) and not dense numbers, so
a rank needs no global sort. Both rounds send a block's distinct strings once, with the
smallest document that holds each in the block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plotline.llm import buffers, exchange
from plotline.session import durable

U = np.uint64
SIZE = 50
GRAM = 24
SLICE = 1 << 20
RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
          ("kept_sha256", pa.string())]


class Anchors:
    """A block's anchors: the window starts ``first``..``last`` that share one, its row, and two ranks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.prefix = buffers.prefix_hash(data)
        found, a = [], 0
        while a < len(offsets) - 1:  # about a megabyte of whole texts at a time
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
            found.append(self._slice(offsets, a, b))
            a = b
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.last, self.row, where = (np.concatenate(c) for c in zip(none, *found))
        self.rank = buffers.span_hash(self.prefix, where, where + GRAM)
        shape = (where - self.first).astype(U) * U(0x9E3779B97F4A7C15) + (self.last - self.first).astype(U) * U(0xC2B2AE3D27D4EB4F)
        self.reach = buffers.mix(buffers.span_hash(self.prefix, self.first, self.last + SIZE) + shape)

    def _slice(self, offsets: np.ndarray, a: int, b: int):
        """First and last window, row and place of the anchors of rows a to b."""
        begin, windows = int(offsets[a]), int(offsets[b] - offsets[a]) - SIZE + 1
        if windows <= 0:
            return (np.zeros(0, np.int64),) * 4
        at = np.arange(begin, int(offsets[b]) - GRAM + 1)
        least = (buffers.span_hash(self.prefix, at, at + GRAM) & U(0xFFFFFFFF00000000)) | (at - begin).astype(U)
        wide, width = SIZE - GRAM + 1, 1
        while width < wide:
            by = min(width, wide - width)
            least = np.minimum(least[:len(least) - by], least[by:])
            width += by
        row = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(offsets[a:b + 1]))
        inside = np.flatnonzero(row[:windows] == row[SIZE - 1:])
        anchor, row = (least[inside] & U(0xFFFFFFFF)).astype(np.int64), row[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (np.diff(anchor) != 0) | (np.diff(row) != 0)
        firsts = np.flatnonzero(new)
        last = inside[np.r_[firsts[1:], len(inside)] - 1] if len(firsts) else firsts
        return inside[firsts] + begin, last + begin, row[firsts].astype(np.int64), anchor[firsts] + begin

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every window of some anchors: start, row and rank of its 50 bytes, from the pair of 25-byte ranks."""
        n = self.last[chosen] - self.first[chosen] + 1
        start = np.repeat(self.first[chosen] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        half = SIZE // 2
        left = buffers.span_hash(self.prefix, start, start + half)
        right = buffers.span_hash(self.prefix, start + half, start + SIZE)
        return start, np.repeat(self.row[chosen], n), buffers.mix(left * U(0x9FB21C651E98DF25) + right)


class Held:
    """A block's distinct keys with the smallest document of each."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray) -> None:
        order = np.lexsort((docs, keys))
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        group = np.cumsum(new) - 1
        firsts = order[new]
        back = np.argsort(firsts, kind="stable")  # in text order, so document ids repeat
        place = np.empty(len(back), np.int64)
        place[back] = np.arange(len(back))
        self.at = firsts[back]
        self.group = np.empty(len(keys), np.int64)
        self.group[order] = place[group]
        self.least = docs[self.at]


def _smallest(key: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The smallest document of each entry's key."""
    order = np.lexsort((docs, key))
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    out = np.empty_like(docs)
    out[order] = docs[order][new][np.cumsum(new) - 1]
    return out


def _deltas(docs: np.ndarray) -> np.ndarray:
    return np.diff(docs, prepend=0)


def _docs_of(deltas: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Undo ``_deltas`` for payloads laid end to end."""
    total = np.cumsum(deltas)
    before = np.where(starts > 0, total[np.maximum(starts - 1, 0)], 0)
    return total - np.repeat(before, np.diff(np.r_[starts, len(deltas)]))


def dealt(rank: np.ndarray) -> np.ndarray:
    """Ranks of anchors, mixed again: as the smallest of a window they have small top bits, which would crowd the first partitions."""
    return buffers.mix(rank ^ U(0x94D049BB133111EB))


def _six(values: np.ndarray) -> np.ndarray:
    """The low 48 bits of each value as six bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").reshape(-1)


def _from_six(values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(values), 8), np.uint8)
    out[:, :6] = np.frombuffer(values.tobytes(), np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1).astype(U)


def _payloads(keys: np.ndarray, docs: np.ndarray, columns, parts: int):
    """Like ``exchange.by_part``, document ids as differences inside each payload."""
    order, edges = exchange.order_of(keys, parts)
    columns = [c[order] for c in columns]
    docs = docs[order]
    for p in np.flatnonzero(np.diff(edges)):
        cut = slice(edges[p], edges[p + 1])
        yield p, exchange.packed([*[c[cut] for c in columns], _deltas(docs[cut])])


def _read(payloads: list[bytes], kinds: list):
    parts = [exchange.unpacked(x, [*kinds, np.int64]) for x in payloads]
    starts = np.cumsum([0, *(len(x[0]) for x in parts)])
    columns = [np.concatenate(c) for c in zip(*parts)]
    return [*columns[:-1], _docs_of(columns[-1], starts[:-1])], starts


def spans_removed(docs: DataFrame, use, schema: str | StructType, more: tuple[str, ...] = ()) -> DataFrame:
    """``use(ids, data, offsets, gone)`` makes the rows of a block; ``gone`` marks the bytes to remove.

    The columns ``more`` travel with the texts to the last step and come last, as one record batch.
    """
    docs = exchange.documents(docs, more=more)
    parts, tasks = exchange.dealing(docs)

    def first_keys(anchors: Anchors, ids: np.ndarray) -> Held:
        return Held(buffers.mix(anchors.rank) ^ anchors.reach, ids[anchors.row])

    def ask_anchors(ids, data, offsets):
        anchors = Anchors(data, offsets)
        held = first_keys(anchors, ids)
        rank, reach = anchors.rank[held.at], anchors.reach[held.at]
        yield from _payloads(dealt(rank), held.least, [rank.astype(np.uint32), _six(reach)], parts)

    def answer_anchors(payloads):
        (rank, reach, least), starts = _read(payloads, [np.uint32, "V6"])
        reach = _from_six(reach)
        key = buffers.mix(rank.astype(U) * U(0xD6E8FEB86659FD93)) ^ reach
        order = np.lexsort((reach, rank))
        new_rank = np.ones(len(rank), bool)
        new_rank[1:] = rank[order][1:] != rank[order][:-1]
        new_reach = new_rank.copy()
        new_reach[1:] |= reach[order][1:] != reach[order][:-1]
        group = np.cumsum(new_rank) - 1
        several = np.empty(len(rank), bool)
        several[order] = (np.bincount(group, new_reach) > 1)[group]
        reply = ((_smallest(key, least) < least) | (several.astype(np.uint8) << 1)).astype(np.uint8)
        return [reply[a:b] for a, b in zip(starts[:-1], starts[1:])]

    def open_anchors(anchors: Anchors, ids: np.ndarray, replies: dict):
        """Anchors whose whole reach is a repeat, and those whose windows are still open."""
        held = first_keys(anchors, ids)
        reply = exchange.reply_for(dealt(anchors.rank[held.at]), parts, replies, np.uint8)[held.group]
        repeat = (reply & 1 > 0) | (ids[anchors.row] > held.least[held.group])
        return repeat, np.flatnonzero(~repeat & (reply & 2 > 0))

    def ask_windows(block, guard, ids, data, offsets, replies):
        anchors = Anchors(data, offsets)
        _, still = open_anchors(anchors, ids, replies[0])
        _, row, rank = anchors.windows(still)
        held = Held(rank, ids[row])
        rank = rank[held.at]
        rows = [(int(p), block, guard, payload) for p, payload in _payloads(rank, held.least, [rank], parts)]
        return exchange.table(rows, exchange.ROW_SCHEMA)

    def answer_windows(payloads):
        (rank, least), starts = _read(payloads, [U])
        reply = (_smallest(rank, least) < least).astype(np.uint8)
        return [reply[a:b] for a, b in zip(starts[:-1], starts[1:])]

    def finish(block, guard, ids, data, offsets, replies, *carried):
        anchors = Anchors(data, offsets)
        repeat, still = open_anchors(anchors, ids, replies[0])
        start, row, rank = anchors.windows(still)
        held = Held(rank, ids[row])
        reply = exchange.reply_for(rank[held.at], parts, replies[1], np.uint8)[held.group]
        again = (reply > 0) | (ids[row] > held.least[held.group])
        begins = np.r_[anchors.first[repeat], start[again]]
        ends = np.r_[anchors.last[repeat], start[again]] + SIZE
        depth = np.bincount(begins, minlength=len(data) + 1) - np.bincount(ends, minlength=len(data) + 1)
        return use(ids, data, offsets, np.cumsum(depth[:len(data)]) > 0, *carried)

    first = durable(exchange.answered(exchange.asked(docs, ask_anchors), answer_anchors, tasks))
    open_windows = exchange.blocks_with(docs, [(first, np.uint8)], ask_windows, exchange.ROWS, tasks)
    second = durable(exchange.answered(open_windows, answer_windows, tasks))
    return exchange.blocks_with(docs, [(first, np.uint8), (second, np.uint8)], finish, schema, tasks, carry=bool(more))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A byte goes if some 50-byte string that covers it also starts in a document with a
    smaller id; all strings are judged on the input. A null or empty text keeps nothing and
    loses nothing. Rows of the same id never remove from each other; rows without an id are
    left out. Memory in a task follows the longest text, about a hundred bytes for each byte.
    """
    def use(ids, data, offsets, gone):
        before = np.r_[False, gone[:-1]][:len(gone)]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        total = np.r_[0, np.cumsum(gone)]
        runs = np.r_[0, np.cumsum(gone & ~before)]
        texts = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(runs[offsets])),
             pa.array([hashlib.sha256(t).hexdigest() for t in texts])], schema=pa.schema(RESULT))
    return spans_removed(docs, use, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every document with the text left; its other columns come with it. A character goes only if all its bytes do."""
    more = tuple(c for c in docs.columns if c not in ("doc_id", "text"))

    def use(ids, data, offsets, gone, *carried):
        lead = (data & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        if len(data) and char[0] < 0:
            char -= char[0]
        kept = np.bincount(char, ~gone) > 0 if len(data) else np.zeros(0, bool)
        stays = kept[char] if len(data) else np.zeros(0, bool)
        upto = np.r_[0, np.cumsum(stays)][offsets]
        left = [pa.array(ids), buffers.strings(data[stays], upto).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*left, *(c for batch in carried for c in batch.columns)], names=["doc_id", "text", *more])
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *docs.select(*more).schema])
    return spans_removed(docs, use, schema, more)

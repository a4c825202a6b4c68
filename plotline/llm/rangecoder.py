"""Operator 5: token ids as binary blocks, coded by mixed predictions of orders 0 to 2.

A block holds some documents' ids. Its ids lie in lanes (equal runs) that are coded in
step, so every operation works on one id of each lane at once; all lanes share one
adaptive model that starts empty in every block:

* order 0: id frequencies of the block so far, recounted after 1, 2, 4, ... and then every 32 steps;
* order 1 and 2: the id that last followed the previous one or two ids, with a confidence of 0 to 3.

The three are mixed into one distribution with weights learnt per confidence: an id's
interval is the weighted sum of its intervals under each, so no escape is needed. A range
coder with 64-bit bounds and 32-bit output codes it. Encoder and decoder run the same model.

Block layout, little endian: magic, ids, documents, lanes, vocabulary, words, CRC-32 of
everything after the header; then documents' sizes (uint32), words a lane, words (uint32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
MAGIC = 0x314B4C42
HEADER = "<7I"
HEADER_BYTES = 28
LANE_IDS = 256
MOST_LANES = 4096
WEIGHT_BITS = 8
SLOTS = 1 << 18


class Model:
    """What encoder and decoder know after the same ids."""

    def __init__(self, vocabulary: int) -> None:
        self.size = vocabulary
        self.bits = max(12, (2 * vocabulary - 1).bit_length())
        self.total = 1 << self.bits
        self.counts = np.zeros(vocabulary, np.int64)
        self.one = np.zeros(vocabulary, np.int64)
        self.two = np.zeros(SLOTS, np.int64)
        self.hits = np.zeros((3, 32))
        self.weights = np.zeros((2, 32), np.int64)
        self.step = 0
        self.recount()
        self.weigh()

    def recount(self) -> None:
        seen = int(self.counts.sum())
        spare = self.total - self.size
        freq = np.ones(self.size, np.int64)
        freq += self.counts * spare // seen if seen else spare // self.size
        freq[int(freq.argmax())] += self.total - int(freq.sum())
        self.freq = freq
        self.cum = np.cumsum(freq) - freq
        self.slot = np.repeat(np.arange(self.size, dtype=np.int32), freq)

    def weigh(self) -> None:
        share = (self.hits[:2] + 0.4) / (self.hits[2] + 1)
        self.weights = (share * ((1 << WEIGHT_BITS) - 2)).astype(np.int64)

    def predict(self, before: np.ndarray, last: np.ndarray):
        self.place = ((before * 0x9E3779B1 + last * 0x85EBCA77) >> 7) & (SLOTS - 1)
        self.got2, self.got1 = self.two[self.place], self.one[last]
        p2, p1 = self.got2 >> 2, self.got1 >> 2
        self.context = ((self.got2 & 3) << 3) | ((self.got1 & 3) << 1) | (p2 == p1)
        w = self.weights[:, self.context]
        return p2, p1, w[0] << self.bits, w[1] << self.bits, (1 << WEIGHT_BITS) - w[0] - w[1]

    def learn(self, last: np.ndarray, ids: np.ndarray, p2: np.ndarray, p1: np.ndarray) -> None:
        hit2, hit1 = p2 == ids, p1 == ids
        for table, place, got, hit in ((self.two, self.place, self.got2, hit2), (self.one, last, self.got1, hit1)):
            sure = got & 3
            table[place] = np.where(hit, got + (sure < 3), np.where(sure > 0, got - 1, ids << 2))
        self.hits[2] += np.bincount(self.context, minlength=32)
        self.hits[0] += np.bincount(self.context, hit2, 32)
        self.hits[1] += np.bincount(self.context, hit1 & ~hit2, 32)
        self.counts += np.bincount(ids, minlength=self.size)
        self.step += 1
        self.weigh()
        if self.step & (self.step - 1) == 0 or self.step % 32 == 0:
            self.recount()


def _shift(low: np.ndarray, span: np.ndarray):
    """Which lanes give out a word, after cutting spans that would stay below 32 bits."""
    same = ((low ^ (low + span)) >> U(32)) == 0
    short = ~same & (span < U(1 << 32))
    span = np.where(short, (~low + U(1)) & U(0xFFFFFFFF), span)
    return same | short, span


def encode_block(ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> bytes:
    """One block of ids (documents' ids in order, ``sizes`` of each)."""
    n = len(ids)
    lanes = min(MOST_LANES, max(1, n // LANE_IDS))
    steps = -(-n // lanes) if n else 0
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(vocabulary)
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    before = last = np.zeros(lanes, np.int64)
    words, given = np.zeros((steps + 2, lanes), np.uint32), np.zeros((steps + 2, lanes), bool)
    scale = U(model.bits + WEIGHT_BITS)
    for t in range(steps):
        now = grid[t]
        p2, p1, a2, a1, a0 = model.predict(before, last)
        freq = a0 * model.freq[now] + a2 * (p2 == now) + a1 * (p1 == now)
        cum = a0 * model.cum[now] + a2 * (p2 < now) + a1 * (p1 < now)
        unit = span >> scale
        low = low + unit * cum.view(U)
        span = unit * freq.view(U)
        out, span = _shift(low, span)
        words[t], given[t] = low >> U(32), out
        by = np.where(out, U(32), U(0))
        low, span = low << by, span << by
        model.learn(last, now, p2, p1)
        before, last = last, now
    if steps:
        words[steps], words[steps + 1] = low >> U(32), low & U(0xFFFFFFFF)
        given[steps:] = True
    each = given.sum(0, dtype=np.uint32)
    body = sizes.astype("<u4").tobytes() + each.astype("<u4").tobytes() + words.T[given.T].astype("<u4").tobytes()
    return struct.pack(HEADER, MAGIC, n, len(sizes), lanes, vocabulary, int(each.sum()), zlib.crc32(body)) + body


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and sizes of one block; a damaged block is refused."""
    magic, n, docs, lanes, vocabulary, total, crc = struct.unpack_from(HEADER, block)
    if magic != MAGIC or len(block) != HEADER_BYTES + 4 * (docs + lanes + total) or zlib.crc32(block[HEADER_BYTES:]) != crc:
        raise ValueError("not a whole block of ids")
    body = np.frombuffer(block, "<u4", -1, HEADER_BYTES)
    sizes, each, words = body[:docs], body[docs:docs + lanes].astype(np.int64), body[docs + lanes:].astype(U)
    steps = -(-n // lanes) if n else 0
    if not steps:
        return np.zeros(0, np.uint32), sizes
    model = Model(vocabulary)
    at = np.cumsum(each) - each
    code = (words[at] << U(32)) | words[at + 1]
    at = at + 2
    words = np.r_[words, U(0)]
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    before = last = np.zeros(lanes, np.int64)
    grid = np.zeros((steps, lanes), np.uint32)
    scale = U(model.bits + WEIGHT_BITS)
    for t in range(steps):
        p2, p1, a2, a1, a0 = model.predict(before, last)
        c2 = a0 * model.cum[p2] + a1 * (p1 < p2)
        c1 = a0 * model.cum[p1] + a2 * (p2 < p1)
        same = p2 == p1
        f2 = a0 * model.freq[p2] + a2 + a1 * same
        f1 = a0 * model.freq[p1] + a1 + a2 * same
        unit = span >> scale
        value = ((code - low) // unit).view(np.int64)
        past2, past1 = value >= c2 + f2, value >= c1 + f1
        in2, in1 = (value >= c2) & ~past2, (value >= c1) & ~past1
        rest = value - a2 * past2 - a1 * past1
        now = model.slot[np.clip(rest // a0, 0, model.total - 1)].astype(np.int64)
        now = np.where(in2, p2, np.where(in1, p1, now))
        freq = a0 * model.freq[now] + a2 * (p2 == now) + a1 * (p1 == now)
        cum = a0 * model.cum[now] + a2 * (p2 < now) + a1 * (p1 < now)
        low = low + unit * cum.view(U)
        span = unit * freq.view(U)
        out, span = _shift(low, span)
        by = np.where(out, U(32), U(0))
        low, span = low << by, span << by
        code = np.where(out, (code << U(32)) | words[np.minimum(at, len(words) - 1)], code)
        at = at + out
        grid[t] = now
        model.learn(last, now, p2, p1)
        before, last = last, now
    return np.ascontiguousarray(grid.T).reshape(-1)[:n], sizes

"""Operator 1: SentencePiece encoding and decoding with a unigram model.

Pieces with log scores lie in a double-array trie over their UTF-8 bytes: from node s, byte b
leads to base[s] + b if check there says s. Encoding is the Viterbi path of the highest sum
of scores; ties go to the path whose last piece is longer. A character that no piece covers
alone costs ``UNKNOWN`` less than the worst piece and comes out as its byte pieces. Words
(pre-tokens, which no piece crosses) are searched in batches: one array step follows the trie
for all words at once. Decoding joins pieces, turns byte pieces into bytes and white-space
markers into spaces, and drops the marker put before the text.

The vocabulary file at hand holds ranks, not log scores; a piece of rank r scores
-log(r + 3), a Zipf law, in millionths so that sums are exact. Nothing is trained.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plotline.llm import buffers, exchange, pieces

UNKNOWN = 10e6
MARK = pieces.MARK.encode()
RESULT = "doc_id long, n_tokens long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, exact boolean"


class Vocabulary:
    """Pieces, scores, and the trie. ``normal`` maps piece bytes to (id, score), ``byte_ids`` bytes to their pieces."""

    def __init__(self, texts: list[bytes], normal: dict[bytes, tuple[int, float]], byte_ids: np.ndarray) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.byte_ids = byte_ids
        self.worst = min(s for _, s in normal.values()) - UNKNOWN
        self.longest = max(map(len, normal))
        self._build(normal)

    def _build(self, normal: dict[bytes, tuple[int, float]]) -> None:
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for piece, value in normal.items():
            node = 0
            for b in piece:
                node = tree[node].setdefault(b, len(tree))
                if node == len(tree):
                    tree.append({})
            ends[node] = value
        size = 2 * len(tree) + 4096
        used, base = np.zeros(size, bool), np.zeros(len(tree), np.int64)
        used[:257] = True
        branching = sorted((n for n in range(len(tree)) if len(tree[n]) > 1), key=lambda n: -len(tree[n]))
        lowest = 0
        for node in branching:  # widest first, so that the narrow ones fill the gaps
            kids = np.array(sorted(tree[node]))
            lowest += int(np.argmin(used[lowest:]))
            free, width = lowest, 64
            while True:
                starts = np.arange(free, free + width) - kids[0]
                fit = np.flatnonzero(~used[starts[:, None] + kids].any(axis=1))
                if len(fit):
                    break
                free, width = free + width, 2 * width
            base[node] = starts[fit[0]]
            used[base[node] + kids] = True
        gaps = iter(np.flatnonzero(~used).tolist())
        for node, kids in enumerate(tree):
            if len(kids) == 1:
                base[node] = next(gaps) - next(iter(kids))
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.piece, self.score = np.full(size, -1, np.int32), np.zeros(size)
        place = np.zeros(len(tree), np.int64)
        for node, kids in enumerate(tree):  # parents come before their children
            self.base[place[node]] = base[node]
            if node in ends:
                self.piece[place[node]], self.score[place[node]] = ends[node]
            for b, kid in kids.items():
                place[kid] = base[node] + b
                self.check[place[kid]] = place[node]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids laid end to end, markers as spaces; the marker before a text is still there."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.begins[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and the offset of each word's ids, longest words apart so padding stays small."""
        lengths = np.diff(offsets)
        order = np.argsort(lengths, kind="stable")
        tokens = np.full(len(data), -1, np.int32)
        at = 0
        while at < len(order):
            widest = max(16, 2 * int(lengths[order[at]]))
            to = int(np.searchsorted(lengths[order], widest, side="right"))
            to = min(to, at + max(1, (1 << 21) // widest))
            self._viterbi(data, offsets, order[at:to], tokens)
            at = to
        found = tokens >= 0
        return tokens[found], np.r_[0, np.cumsum(found)][offsets]

    def _viterbi(self, data, offsets, chosen, tokens) -> None:
        """Write each piece's id at the byte where it begins (byte pieces: at every byte of the character)."""
        begins, lengths = offsets[chosen], np.diff(offsets)[chosen]
        width = int(lengths.max(initial=0))
        if not width:
            return
        n = len(chosen)
        cell = np.minimum(begins[:, None] + np.arange(width), len(data) - 1)
        text = data[cell].astype(np.int32)
        text[np.arange(width) >= lengths[:, None]] = -1
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        come, got = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        char = np.where(text >= 0xF0, 4, np.where(text >= 0xE0, 3, np.where(text >= 0xC0, 2, 1)))
        for s in range(width):
            rows = np.flatnonzero((text[:, s] >= 0) & ((text[:, s] & 0xC0) != 0x80))
            alone = np.zeros(n, bool)
            live, node = rows, np.zeros(len(rows), np.int32)
            for d in range(s, min(width, s + self.longest)):
                b = text[live, d]
                to = self.base[node] + b
                ok = (b >= 0) & (self.check[np.maximum(to, 0)] == node) & (to > 0)
                live, node = live[ok], to[ok]
                if not len(live):
                    break
                end = self.piece[node] >= 0
                hit, at = live[end], node[end]
                alone[hit[char[hit, s] == d + 1 - s]] = True
                total = best[hit, s] + self.score[at]
                better = total > best[hit, d + 1]
                hit = hit[better]
                best[hit, d + 1], come[hit, d + 1], got[hit, d + 1] = total[better], s, self.piece[at[better]]
            rest = rows[~alone[rows]]
            to = np.minimum(s + char[rest, s], lengths[rest])
            total = best[rest, s] + self.worst
            better = total > best[rest, to]
            rest, to = rest[better], to[better]
            best[rest, to], come[rest, to], got[rest, to] = total[better], s, -1
        rows, at = np.arange(n), lengths.copy()
        while len(rows):
            start, piece = come[rows, at].astype(np.int64), got[rows, at]
            whole = piece >= 0
            tokens[begins[rows[whole]] + start[whole]] = piece[whole]
            for r, a, b in zip(rows[~whole], start[~whole], at[~whole]):
                span = slice(begins[r] + a, begins[r] + b)
                tokens[span] = self.byte_ids[data[span]]
            keep = start > 0
            rows, at = rows[keep], start[keep]


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary file's pieces with scores by rank, built once."""
    held = buffers.worker_cache().__dict__.setdefault("unigram", {})
    if path not in held:
        model = pieces.opened(path)
        texts, normal, byte_ids = [], {}, np.zeros(256, np.int32)
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(text[3:5], 16)] = i
                texts.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                texts.append(b"")
            else:
                texts.append(text.replace(pieces.MARK, " ").encode())
                normal[text.encode()] = (i, -float(round(1e6 * np.log(len(normal) + 3))))
        held[path] = Vocabulary(texts, normal, byte_ids)
    return held[path]


def _marked(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens with the marker that ``pretokens`` leaves out."""
    data, offsets = buffers.flat(keys)
    n = np.diff(offsets)
    plain = np.ones(len(n), bool)
    plain[n > 0] = data[offsets[:-1][n > 0]] != 10
    added = np.where(plain, len(MARK), 0)
    upto = np.r_[0, np.cumsum(n + added)]
    out = np.zeros(int(upto[-1]), np.uint8)
    at = upto[:-1][plain]
    for k, b in enumerate(MARK):
        out[at + k] = b
    out[np.arange(len(data)) + np.repeat(upto[:-1] + added - offsets[:-1], n)] = data
    return out, upto


def encode(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block of texts and the offset of each text's ids; each distinct pre-token is searched once."""
    keys, chosen, row = pieces.pretokens(data, offsets)
    if not len(chosen):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    order = np.argsort(row, kind="stable")
    chosen, row = chosen[order], row[order]
    ids, upto = vocab.encode_words(*_marked(keys))
    n = np.diff(upto)[chosen]
    ends = np.cumsum(n)
    out = ids[np.repeat(upto[:-1][chosen] - (ends - n), n) + np.arange(int(ends[-1]))]
    return out, np.r_[0, ends][np.searchsorted(row, np.arange(len(offsets)))]


def coded(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text, decode the ids, and compare.

    doc_id, n_tokens, n_byte_pieces, ids_crc32 (ids as little-endian unsigned 32-bit),
    decoded_crc32 (of the decoded bytes) and exact (the decoded text is the text; a text that
    holds the white-space marker itself decodes to spaces). A null or empty text has no ids
    and decodes to nothing. Rows without an id are left out.
    """
    vocab = vocabulary(path)  # travels with the function; its size is the vocabulary file's

    def run(batches):
        is_byte = np.zeros(len(vocab.sizes), bool)
        is_byte[vocab.byte_ids] = True
        for batch in buffers.blocks(batches):
            data, offsets = buffers.flat(batch.column("text"))
            ids, upto = encode(vocab, data, offsets)
            fell = np.r_[0, np.cumsum(is_byte[ids])][upto]
            sizes = np.r_[0, np.cumsum(vocab.sizes[ids])][upto]
            back, raw = memoryview(vocab.decode(ids).tobytes()), memoryview(ids.astype("<u4").tobytes())
            text = memoryview(data.tobytes())
            crc, decoded, exact = [], [], []
            for i in range(batch.num_rows):
                got = back[sizes[i] + (1 if sizes[i + 1] > sizes[i] else 0):sizes[i + 1]]
                crc.append(zlib.crc32(raw[4 * upto[i]:4 * upto[i + 1]]))
                decoded.append(zlib.crc32(got))
                exact.append(got == text[offsets[i]:offsets[i + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(upto)), pa.array(np.diff(fell)), pa.array(crc, pa.int64()),
                 pa.array(decoded, pa.int64()), pa.array(exact)],
                names=["doc_id", "n_tokens", "n_byte_pieces", "ids_crc32", "decoded_crc32", "exact"])
    return exchange.documents(docs).mapInArrow(run, RESULT)

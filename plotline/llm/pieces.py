"""Operator 9: token counts, and the pre-tokens of a SentencePiece vocabulary.

A pre-token is a run of white-space markers with the characters up to the next marker or
line break, or a line break with what follows it. No piece of the vocabulary holds a
marker after another character, or a line break beside its byte piece, so no merge crosses
a pre-token and a text's pieces are its pre-tokens' pieces in order (checked when a model
is opened). Every distinct pre-token is counted once in the whole corpus; documents fetch
the counts of the pre-tokens they hold and sum them by frequency.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plotline.llm import buffers, exchange

MARK = "▁"
ODD = re.compile(rf"(?:\n|[ {MARK}]+)[^ {MARK}\n]*")
RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]


def opened(path: str):
    """The library's processor, once per worker, refused if pre-tokens could merge."""
    held = buffers.worker_cache().__dict__.setdefault("sentencepiece", {})
    if path not in held:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"piece {piece!r} crosses pre-tokens")
        held[path] = model
    return held[path]


def _begins_with(data: np.ndarray, offsets: np.ndarray, value: int) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, bool)
    some = np.diff(offsets) > 0
    out[some] = data[offsets[:-1][some]] == value
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a block, and for each occurrence its place among them and its row.

    A pre-token that begins with a marker is written without that one (the library puts
    it back); one that begins with a line break is written whole. A text without bytes has none.
    """
    n = len(offsets) - 1
    rows = lambda places: np.searchsorted(offsets, places, side="right") - 1
    odd = _begins_with(data, offsets, 32)
    if len(data) > 2:
        odd[rows(np.flatnonzero((data[:-1] == 32) & (data[1:] == 32)))] = True
        odd[rows(np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)))] = True
    elif (data == 32).all():
        odd[np.diff(offsets) > 0] = True
    breaks = np.flatnonzero(data == 10)
    text = np.repeat(data, 1 + (data == 10))
    text[breaks + np.arange(len(breaks))] = 32
    spread = offsets + np.searchsorted(breaks, offsets)
    lists = pc.split_pattern(buffers.strings(text, spread), " ")
    per_row = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(n), per_row)
    keys = lists.flatten()
    empty = np.diff(offsets) == 0
    if odd.any() or empty.any():
        keep = ~(odd | empty)[row]
        more, more_rows = [], []
        for i in np.flatnonzero(odd):
            found = ODD.findall(MARK + data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
            more += [t if t[0] == "\n" else t[1:].replace(" ", MARK) for t in found]
            more_rows += [i] * len(found)
        keys = pa.concat_arrays([keys.filter(pa.array(keep)), pa.array(more, pa.large_string())])
        row = np.r_[row[keep], np.array(more_rows, np.int64)]
    coded = keys.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), row


def ended(keys: pa.Array) -> bytes:
    """Pre-tokens, which never hold a space, each with a space behind it."""
    text, offsets = buffers.flat(keys)
    out = np.full(len(text) + len(keys), 32, np.uint8)
    out[np.arange(len(text)) + np.repeat(np.arange(len(keys)), np.diff(offsets))] = text
    return out.tobytes()


def cut(data: np.ndarray) -> pa.Array:
    """The pre-tokens that ``ended`` wrote."""
    ends = np.flatnonzero(data == 32)
    return buffers.strings(data[data != 32], np.r_[0, ends - np.arange(len(ends))])


def key_hashes(keys: pa.Array) -> np.ndarray:
    data, offsets = buffers.flat(keys)
    return buffers.span_hash(buffers.prefix_hash(data), offsets[:-1], offsets[1:])


def piece_counts(model, keys: list[str]) -> np.ndarray:
    """Pieces of each pre-token; the marker that the library adds before a line break is taken off."""
    counts = np.fromiter(map(len, model.encode(keys, num_threads=1)), np.int64, len(keys))
    for i, key in enumerate(keys):
        if not key:
            counts[i] = 1
        elif key[0] == "\n":
            counts[i] -= 1
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    One row per input row with an id. A null or empty text has 0 bytes and 0 tokens.
    """
    docs = exchange.documents(docs)
    parts, tasks = exchange.dealing(docs)

    def ask(ids, data, offsets):
        keys = pretokens(data, offsets)[0]
        order, edges = exchange.order_of(key_hashes(keys), parts)
        keys = keys.take(pa.array(order))
        for p in np.flatnonzero(np.diff(edges)):
            yield p, ended(keys.slice(edges[p], edges[p + 1] - edges[p]))

    def answer(payloads):
        arrays = [cut(np.frombuffer(x, np.uint8)) for x in payloads]
        coded = pa.concat_arrays(arrays).dictionary_encode()
        counts = piece_counts(opened(path), coded.dictionary.to_numpy(zero_copy_only=False).tolist()).astype(np.uint32)
        replies, at = counts[coded.indices.to_numpy()], 0
        out = []
        for a in arrays:
            out.append(replies[at:at + len(a)])
            at += len(a)
        return out

    def use(block, guard, ids, data, offsets, replies):
        keys, chosen, row = pretokens(data, offsets)
        counts = exchange.reply_for(key_hashes(keys), parts, replies[0], np.uint32)
        tokens = np.bincount(row, counts[chosen], len(ids)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
            schema=pa.schema(RESULT))

    answers = exchange.answered(exchange.asked(docs, ask), answer, tasks)
    return exchange.blocks_with(docs, [(answers, np.uint32)], use,
                                "doc_id long, n_bytes long, n_tokens long, over_limit boolean", tasks)

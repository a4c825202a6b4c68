"""Token ids of whole texts: the tokenizers library run once per distinct word.

For the tokenizer used here no normalisation, pre-token or special token crosses white
space, and in texts of Latin-1 letters the pre-tokens follow from byte classes alone. So
those texts are cut into pre-tokens by array operations, coded as a dictionary by Arrow,
and the library sees each pre-token that a worker has not met. Any other text (further
letters, control characters, or ``<|``, which a special token may follow) is cut at white
space only, and its chunks go through the library's whole pipeline.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from plotline.llm import buffers

MEMO = 400_000
SPACE, LETTER, DIGIT, OTHER, BAD = range(5)
#: C2-led characters that are letters, numbers or spaces, not punctuation (fixed by Unicode).
C2_ODD = (0xAA, 0xB5, 0xBA, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    table = np.full(256, BAD, np.uint8)
    table[33:127] = OTHER
    table[48:58] = DIGIT
    table[97:123] = LETTER
    table[32] = SPACE
    table[0xC2], table[0xC3] = OTHER, LETTER
    return table


def _second_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes may follow C2 (punctuation) and C3 (lower-case letters)."""
    value = np.arange(256)
    after_c2 = (value >= 0xA1) & (value <= 0xBF) & ~np.isin(value, C2_ODD)
    after_c3 = (value >= 0x9F) & (value <= 0xBF) & (value != 0xB7)
    return after_c2, after_c3


def _spaced() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[9:14] = 32
    return table


def _rows(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, places, side="right") - 1


class Words:
    """Ids of words, kept for the life of a worker and bounded in number."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.last[i] = piece.endswith("</w>")
        self.memo: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Words joined by spaces in long lines; a word ends where its last piece does."""
        if not words:
            return {}
        lines = [" ".join(words[i:i + 4096]) for i in range(0, len(words), 4096)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in
                              self.bare.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("words and pieces do not line up")
        raw, out, at = ids.tobytes(), {}, 0
        for word, to in zip(words, (ends * 4).tolist()):
            out[word] = raw[at:to]
            at = to
        return out

    def _look_up(self, words: list[str]) -> list[bytes]:
        memo = self.memo
        new = self.learn([w for w in words if w not in memo])
        if len(memo) < MEMO:
            memo.update(new)
        return [memo[w] if w in memo else new[w] for w in words]

    def _plain(self, text: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose bytes all have a class."""
        start = np.ones(len(text), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
        start |= kinds == DIGIT
        start[offsets[:-1][offsets[:-1] < len(text)]] = True
        for i in np.flatnonzero((text[:-1] == 39) & start[:-1] & (kinds[1:] == LETTER)).tolist():
            size = {115: 1, 116: 1, 109: 1, 100: 1}.get(int(text[i + 1]), 0)
            if not size and text[i + 1:i + 3].tobytes() in (b"re", b"ve", b"ll") and not start[i + 2]:
                size = 2
            if size and not (offsets == i + 1).any():
                start[i + 1] = False
                if i + 1 + size < len(text) and kinds[i + 1 + size] == LETTER:
                    start[i + 1 + size] = True
        seen = kinds != SPACE
        start &= seen
        counts = np.searchsorted(np.flatnonzero(start), offsets)
        begins = np.flatnonzero(start[seen])
        bytes_ = text[seen]
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = buffers.strings(bytes_, np.r_[begins, len(bytes_)]).dictionary_encode()
        parts = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        blob = np.frombuffer(b"".join(parts), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        firsts = np.cumsum(sizes) - sizes
        chosen = coded.indices.to_numpy()
        n = sizes[chosen]
        ends = np.cumsum(n)
        ids = blob[np.repeat(firsts[chosen] - (ends - n), n) + np.arange(int(ends[-1]))]
        return ids, np.r_[0, ends][counts]

    def _odd(self, text: str) -> np.ndarray:
        chunks = text.split(" ")
        if len(chunks) < 4:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        distinct = list(dict.fromkeys(chunks))
        got = {c: np.array(e.ids, np.uint32) for c, e in
               zip(distinct, self.whole.encode_batch_fast(distinct, add_special_tokens=False))}
        return np.concatenate([got[c] for c in chunks])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts and the offset of each text's ids."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        text = _spaced()[data]
        text = buffers.lower_table()[text]
        kinds = _classes()[text]
        after_c2, after_c3 = _second_bytes()
        odd = np.zeros(len(offsets) - 1, bool)
        for lead, fits in ((0xC2, after_c2), (0xC3, after_c3)):
            at = np.flatnonzero(text == lead)
            at = at[at + 1 < len(text)]
            second = text[at + 1]
            if lead == 0xC3:
                second = np.where((second < 0x9F) & (second != 0x97), second + 32, second).astype(np.uint8)
                text[at + 1] = second
            kinds[at + 1] = np.where(fits[second], kinds[at], BAD)
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        odd[_rows(offsets, np.flatnonzero(kinds == BAD))] = True
        odd[_rows(offsets, marks)] = True
        if not odd.any():
            return self._plain(text, offsets, kinds)
        kinds[np.repeat(odd, np.diff(offsets))] = SPACE
        ids, upto = self._plain(text, offsets, kinds)
        spaced = _spaced()
        parts = [self._odd(spaced[data[offsets[i]:offsets[i + 1]]].tobytes().decode()) if odd[i]
                 else ids[upto[i]:upto[i + 1]] for i in range(len(odd))]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def words(path: str) -> Words:
    held = buffers.worker_cache().__dict__.setdefault("words", {})
    if path not in held:
        held[path] = Words(path)
    return held[path]


def with_end(ids: np.ndarray, upto: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end``."""
    n = len(upto) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(upto))] = ids
    return out, upto + np.arange(n + 1)

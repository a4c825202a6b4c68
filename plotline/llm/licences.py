"""Operator 3: licence scans over a generalised suffix automaton of licence words.

All templates (notices, licence paragraphs, and the base phrases) are words of one
automaton. A text streams through it: at each word, the longest run of words ending there
that stands in some template, and its state. A match that the next word does not extend and
that is long enough is tied to every place of each template that holds it; such matches are
chained in text and template order, and a template covered far enough gives its label. Base
phrases are read off the same states.

A word that no template holds sends the automaton to its root, and a match of two words is a
pair that some template holds. So only stretches of such pairs are streamed; array
operations find them.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plotline.llm import buffers, exchange

# Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices and paragraphs of public licences, with the label each gives.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

LEAST_MATCH = 3
LEAST_COVER = 0.8
MOST_GAP = 8
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().translate(buffers.lower_table().tobytes()))


class Automaton:
    """A generalised suffix automaton over word numbers, with all places (template, end) of each state."""

    def __init__(self, templates: list[list[bytes]], phrases: list[list[bytes]]) -> None:
        everything = templates + phrases
        self.numbers = {w: i for i, w in enumerate(sorted({w for t in everything for w in t}))}
        coded = [[self.numbers[w] for w in t] for t in everything]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]
        for number, text in enumerate(coded):
            last = 0
            for end, word in enumerate(text):
                last = self._add(last, word)
                self.places[last].add((number, end))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.places[self.link[state]] |= self.places[state]
        self.sizes = [len(t) for t in templates]
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        found = {}
        for p, text in enumerate(coded[len(templates):]):
            state = 0
            for word in text:
                state = self.next[state][word]
            found[state] = found.get(state, []) + [(p, len(text))]
        for state in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.ends[state] = found.get(state, []) + self.ends[self.link[state]]
        self.pairs = np.unique([a * len(self.numbers) + b for t in coded for a, b in zip(t[:-1], t[1:])])

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The target of ``word`` from ``state``, cut so that it ends words of that length only."""
        to = self.next[state][word]
        if self.length[to] == self.length[state] + 1:
            return to
        twin = self._new(self.length[state] + 1)
        self.next[twin] = dict(self.next[to])
        self.link[twin], self.link[to] = self.link[to], twin
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def _add(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state = self._new(self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        self.link[state] = self._split(last, word) if last >= 0 else 0
        return state

    def statistics(self, words: list[int]):
        """For each word: the longest match that ends there, and its state."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
            yield length, state


def covered(matches: list[tuple[int, int, int]], size: int, gap: int = MOST_GAP) -> int:
    """Words of a template under the best chain of matches (text end, template end, length).

    A match is at most ``size`` words long, so only chains that end within ``size`` + ``gap``
    words above it can lead to it; the rest are dropped, and the work grows with the matches.
    """
    near: deque[tuple[int, int, int]] = deque()
    most = 0
    for at, end, n in sorted(matches):
        while near and near[0][0] < at - size - gap:
            near.popleft()
        total = n
        for before, was, had in near:
            fresh = min(n, end - was, at - before)
            if fresh > 0 and at - n - before <= gap:
                total = max(total, had + fresh)
        near.append((at, end, total))
        most = max(most, total)
    return min(size, most)


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, least_match: int = LEAST_MATCH, least_cover: float = LEAST_COVER) -> DataFrame:
    """Licence labels of every whole text.

    n_words; n_base, first_word and last_word (count, smallest and largest start of the base
    phrases' places; null without one); base_labels; labels (those, and of the templates of
    which a chain of matches of ``least_match`` words or more covers the share
    ``least_cover``); score (the largest share covered, 1 with a base phrase). A null or
    empty text has no words. Rows without an id are left out.
    """
    automaton = Automaton([words_of(t) for _, t in templates], [words_of(t) for t in base])
    names, base_names = [n for n, _ in templates], list(base.values())
    vocabulary = sorted(automaton.numbers, key=automaton.numbers.get)
    data = np.frombuffer(b"".join(vocabulary), np.uint8)
    ends = np.cumsum([len(w) for w in vocabulary])
    hashes = buffers.span_hash(buffers.prefix_hash(data), np.r_[0, ends[:-1]], ends)
    rank = np.argsort(hashes)
    hashes = hashes[rank]
    keep = buffers.byte_table(lambda b: b > 127 or 48 <= b <= 57 or 97 <= b <= 122)

    def one(stretches) -> tuple:
        """Base places, base labels, labels and score of a text from its stretches (start, words)."""
        starts, own, found = [], set(), {}
        for first, words in stretches:
            held = [*automaton.statistics(words), (0, 0)]
            for i, (length, state) in enumerate(held[:-1]):
                for p, n in automaton.ends[state]:
                    if length >= n:
                        starts.append(first + i + 1 - n)
                        own.add(base_names[p])
                if length >= least_match and held[i + 1][0] != length + 1:
                    for t, end in automaton.places[state]:
                        if t < len(names):
                            found.setdefault(t, []).append((first + i, end, length))
        share = {t: covered(m, automaton.sizes[t]) / automaton.sizes[t] for t, m in found.items()}
        labels = own | {names[t] for t, s in share.items() if s >= least_cover}
        return starts, own, labels, max([1.0 if own else 0.0, *share.values()])

    def run(batches):
        for batch in buffers.blocks(batches):
            text, offsets = buffers.flat(batch.column("text"))
            low = buffers.lower_table()[text]
            begins, stops, row = buffers.spans(low, offsets, keep)
            count = np.bincount(row, minlength=batch.num_rows)
            h = buffers.span_hash(buffers.prefix_hash(low), begins, stops)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            number = np.where(hashes[at] == h, rank[at], -1)
            pair = (row[1:] == row[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0)
            pair &= np.isin(number[:-1] * len(rank) + number[1:], automaton.pairs)
            edge = np.diff(np.r_[0, pair.astype(np.int8), 0]) if len(number) else np.zeros(0, np.int8)
            first_word = np.r_[0, np.cumsum(count)]
            stretches: dict[int, list] = {}
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                r = int(row[a])
                stretches.setdefault(r, []).append((a - int(first_word[r]), number[a:b + 1].tolist()))
            rows = []
            for r in range(batch.num_rows):
                starts, own, labels, score = one(stretches[r]) if r in stretches else ([], set(), set(), 0.0)
                rows.append((len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
                             ",".join(sorted(labels)), score))
            n_base, first, last, own, labels, score = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(last, pa.int64()), pa.array(own), pa.array(labels), pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    return exchange.documents(docs).mapInArrow(run, RESULT)

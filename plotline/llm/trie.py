"""A prefix tree of ordered n-gram sets, searched for sets of high Jaccard similarity.

Sets are sequences in one global order, so similar sets share the start of their sequences
or differ in it by few members. A node holds the run of members that all sets below it
share there; a probe counts each run once for all those sets and leaves a subtree as soon
as the members still to come cannot lift any of its sets over the threshold.
"""

from __future__ import annotations

import numpy as np


class Trie:
    """``sequences[i]``: a set's shared n-grams in order; ``sizes[i]``: its whole size."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray) -> None:
        keys = [s.astype(">u8").tobytes() for s in sequences]
        self.order = sorted(range(len(sequences)), key=keys.__getitem__)
        lengths = [len(sequences[i]) for i in self.order]
        common = [0]
        for i, j in zip(self.order[:-1], self.order[1:]):
            n = min(len(sequences[i]), len(sequences[j]))
            differ = np.flatnonzero(sequences[i][:n] != sequences[j][:n])
            common.append(int(differ[0]) if len(differ) else n)
        common = np.array(common)
        runs, depth, left, small, large, held, child = [], [], [], [], [], [], []
        todo = [(0, len(self.order), 0, -1)] if self.order else []
        while todo:
            a, b, above, parent = todo.pop()
            end = lengths[a] if b - a == 1 else int(common[a + 1:b].min())
            node = len(runs)
            runs.append(sequences[self.order[a]][above:end])
            depth.append(end)
            member = self.order[a:b]
            left.append(max(lengths[a:b]) - end)
            small.append(int(sizes[member].min()))
            large.append(int(sizes[member].max()))
            child.append([])
            if parent >= 0:
                child[parent].append(node)
            here = a
            while here < b and lengths[here] == end:
                here += 1
            held.append(self.order[a:here])
            if here < b:
                cuts = [here, *(here + 1 + np.flatnonzero(common[here + 1:b] == end)).tolist(), b]
                todo += [(x, y, end, node) for x, y in zip(cuts[:-1], cuts[1:])]
        self.members = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
        self.ends = np.cumsum([len(r) for r in runs])
        self.begins = self.ends - np.array([len(r) for r in runs], np.int64)
        self.left, self.small, self.large = np.array(left), np.array(small), np.array(large)
        self.held, self.child, self.sizes = held, child, sizes

    def similar(self, ordered: np.ndarray, size: int, percent: int) -> list[int]:
        """Sets whose similarity to the probe (its n-grams sorted by value) is at least ``percent`` / 100."""
        found, nodes, shared = [], np.zeros(min(1, len(self.held)), np.int64), np.zeros(1, np.int64)
        while len(nodes):
            lengths = self.ends[nodes] - self.begins[nodes]
            total = np.cumsum(lengths)
            place = np.repeat(self.begins[nodes] - (total - lengths), lengths) + np.arange(int(total[-1]))
            members = self.members[place]
            at = np.minimum(np.searchsorted(ordered, members), len(ordered) - 1)
            hits = np.r_[0, np.cumsum(ordered[at] == members)]
            shared = shared + hits[total] - hits[total - lengths]
            most = shared + np.minimum(self.left[nodes], len(ordered) - shared)
            fits = ((100 + percent) * most >= percent * (self.small[nodes] + size)) & \
                (100 * self.large[nodes] >= percent * size) & (100 * size >= percent * self.small[nodes])
            below, carried = [], []
            for node, both in zip(nodes[fits].tolist(), shared[fits].tolist()):
                for i in self.held[node]:
                    if (100 + percent) * both >= percent * (int(self.sizes[i]) + size):
                        found.append(i)
                below += self.child[node]
                carried += [both] * len(self.child[node])
            nodes, shared = np.array(below, np.int64), np.array(carried, np.int64)
        return found

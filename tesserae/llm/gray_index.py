"""Hamming search over 64-bit codes by a hierarchical index in Gray order.

Codes are sorted by Gray rank, so that neighbours share long bit patterns. Runs
of leaves form nodes, runs of nodes upper ones. A node keeps the bits that all
codes under it share, less those its ancestors keep already. A search adds up
the differences on the way down and drops a whole group once they pass the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN_OUT = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Distinct codes; positions returned by searches refer to self.codes."""

    def __init__(self, codes: np.ndarray) -> None:
        codes = np.unique(np.asarray(codes, np.uint64))
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        # From the leaves up: the bits that are one, and zero, in all codes under a node.
        levels = [(self.codes, ~self.codes)]
        while len(levels[-1][0]) > FAN_OUT:
            ones, zeros = levels[-1]
            cuts = np.arange(0, len(ones), FAN_OUT)
            levels.append((np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)))
        levels.reverse()
        #: From the top down: pattern, and mask of the bits first shared at this level.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        above = np.zeros(1, np.uint64)
        for k, (ones, zeros) in enumerate(levels):
            shared = ones | zeros
            inherited = above[np.arange(len(ones)) // FAN_OUT] if k else np.zeros(len(ones), np.uint64)
            self.levels.append((ones, shared & ~inherited))
            above = shared

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in queries, position in codes) that differ in limit bits at most."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        queries = np.asarray(queries, np.uint64)
        n_top = len(self.levels[0][0])
        who, node = np.repeat(np.arange(len(queries)), n_top), np.tile(np.arange(n_top), len(queries))
        spent = np.zeros(len(who), np.int16)
        for k, (pattern, mask) in enumerate(self.levels):
            if k:
                width = len(pattern)
                node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                who, spent = np.repeat(who, FAN_OUT), np.repeat(spent, FAN_OUT)
                inside = node < width
                who, node, spent = who[inside], node[inside], spent[inside]
            spent = spent + np.bitwise_count((queries[who] ^ pattern[node]) & mask[node])
            near = spent <= limit
            who, node, spent = who[near], node[near], spent[near]
        return who, node

    def batches(self, limit: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The index joined with itself: pairs of positions, the first before the second, some queries at a time."""
        for start in range(0, len(self.codes), rows):
            who, found = self.search(self.codes[start : start + rows], limit)
            who = who + start
            later = found > who
            yield who[later], found[later]


class Forest:
    """Union-find over positions, by whole arrays of links."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            self.settle()

    def settle(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up

"""Weighted acyclic automata over sequences of 64-bit labels.

A transducer holds counted sequences of labels; the arc that a prefix ends with carries the summed count of all
sequences that begin with it. It is built level by level from sequences in which equal prefixes lie next to each
other, and states with the same outgoing labels, weights and targets are made one from the last level up, as
the incremental construction of a minimal acyclic automaton does state by state. All work is on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from habitatq.llm.words import mix

_U = np.uint64


def summed(paths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``paths`` in lexicographic order and the sum of their weights."""
    if not len(paths):
        return paths, weights
    order = np.lexsort(paths.T[::-1])
    paths, weights = paths[order], weights[order]
    fresh = np.ones(len(paths), bool)
    fresh[1:] = (paths[1:] != paths[:-1]).any(axis=1)
    first = np.flatnonzero(fresh)
    return paths[first], np.add.reduceat(weights, first)


def levels(paths: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level (a row that begins with each prefix, its parent's number, its own numbers by row, its weight).

    ``paths`` has rows of labels, 0 after the end, in which equal prefixes lie next to each other.
    """
    rows, node, made = np.arange(len(paths)), np.zeros(len(paths), np.int64), 1
    for d in range(paths.shape[1]):
        rows = rows[paths[rows, d] != 0]
        if not len(rows):
            return
        label, above = paths[rows, d], node[rows]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (label[1:] != label[:-1]) | (above[1:] != above[:-1])
        first = np.flatnonzero(fresh)
        node = node.copy()
        node[rows] = made + np.cumsum(fresh) - 1
        yield rows[first], above[first], node[rows[first]], np.add.reduceat(weights[rows], first)
        made += len(first)


class Transducer:
    """Arcs (source, label, target, weight); state 0 is the start."""

    def __init__(self, source: np.ndarray, label: np.ndarray, target: np.ndarray, weight: np.ndarray):
        self.labels, rank = np.unique(label, return_inverse=True)
        key = source * max(1, len(self.labels)) + rank
        order = np.argsort(key)
        self.key, self.target, self.weight = key[order], target[order], weight[order]

    @classmethod
    def of(cls, paths: np.ndarray, weights: np.ndarray) -> Transducer:
        """From counted sequences, equal prefixes together; minimised."""
        steps = [(paths[row, d], above, node, weight) for d, (row, above, node, weight) in enumerate(levels(paths, weights))]
        n = 1 + sum(len(s[2]) for s in steps)
        state = np.zeros(n, np.int64)  # representative of each state; all states without arcs are state n
        state[1:] = n
        arcs = []
        for label, above, node, weight in reversed(steps):
            to = state[node]
            sign = mix(mix(mix(label.view(_U)) + weight.view(_U)) + to.view(_U))
            first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            source, which = above[first], np.add.reduceat(sign, first)
            _, one, same = np.unique(which, return_index=True, return_inverse=True)
            state[source] = source[one][same]
            kept = np.isin(above, source[one])
            arcs.append((state[above[kept]], label[kept], to[kept], weight[kept]))
        if not arcs:
            return cls(*(np.zeros(0, np.int64) for _ in range(4)))
        return cls(*(np.concatenate(x) for x in zip(*arcs)))

    def __len__(self) -> int:
        return len(self.key)

    def weights_of(self, queries: np.ndarray) -> np.ndarray:
        """Composition with the acceptor of each row of ``queries`` (labels, 0 after the end): its count, 0 if it is unknown."""
        state, out = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        live = np.arange(len(queries))
        for d in range(queries.shape[1]):
            live = live[queries[live, d] != 0]
            if not len(live) or not len(self.key):
                out[live] = 0
                return out
            rank = np.minimum(np.searchsorted(self.labels, queries[live, d]), len(self.labels) - 1)
            key = state[live] * len(self.labels) + rank
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            known = (self.labels[rank] == queries[live, d]) & (self.key[arc] == key)
            out[live] = np.where(known, self.weight[arc], 0)
            state[live[known]] = self.target[arc[known]]
            live = live[known]
        return out

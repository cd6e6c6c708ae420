"""A prefix tree of ordered token sets, for set-similarity search inside one task.

Sets are sequences of token ranks in one global order (rare tokens first). Sets with a
common beginning share a path, so the overlap with a searched set is counted once
for all of them; a subtree is left as soon as no set of its lengths can still reach
the wanted similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class _Node:
    __slots__ = ("tokens", "children", "ends", "shortest", "longest")

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.children: dict[int, _Node] = {}
        self.ends: list[int] = []
        self.shortest, self.longest = 1 << 62, 0


class PrefixTree:
    """``similarity`` is a pair (a, b): sets are similar if b * |x and y| >= a * |x or y|."""

    def __init__(self, n_tokens: int, similarity: tuple[int, int] = (3, 4)):
        self._root = _Node(np.empty(0, np.int64))
        self._marks = np.zeros(n_tokens, bool)
        # b * o >= a * (x + y - o)  <=>  (a + b) * o >= a * (x + y)
        self._need, self._per = similarity[0], sum(similarity)

    def add(self, name: int, ranks: np.ndarray) -> None:
        node, at, size = self._root, 0, len(ranks)
        while True:
            node.shortest, node.longest = min(node.shortest, size), max(node.longest, size)
            if at == size:
                node.ends.append(name)
                return
            child = node.children.get(int(ranks[at]))
            if child is None:
                leaf = _Node(ranks[at:])
                leaf.shortest = leaf.longest = size
                leaf.ends.append(name)
                node.children[int(ranks[at])] = leaf
                return
            n = min(len(child.tokens), size - at)
            differs = np.flatnonzero(child.tokens[:n] != ranks[at : at + n])
            shared = int(differs[0]) if len(differs) else n
            if shared < len(child.tokens):
                upper = _Node(child.tokens[:shared])
                upper.shortest, upper.longest = child.shortest, child.longest
                child.tokens = child.tokens[shared:]
                upper.children[int(child.tokens[0])] = child
                node.children[int(ranks[at])] = child = upper
            node, at = child, at + shared

    def similar(self, ranks: np.ndarray) -> Iterator[int]:
        """Names of all added sets similar to the given one, likely ones first."""
        marks, size = self._marks, len(ranks)
        marks[ranks] = True
        try:
            stack = [(self._root, 0, 0, 0)]
            while stack:
                node, depth, overlap, used = stack.pop()
                if len(node.tokens):
                    depth += len(node.tokens)
                    overlap += int(np.count_nonzero(marks[node.tokens]))
                    used = int(np.searchsorted(ranks, node.tokens[-1], "right"))
                left = size - used
                # the length in the subtree for which most overlap may be left
                length = min(max(depth + left, node.shortest), node.longest)
                if self._per * (overlap + min(length - depth, left)) < self._need * (size + length):
                    continue
                if node.ends and self._per * overlap >= self._need * (size + depth):
                    yield from node.ends
                for first, child in node.children.items():
                    entry = (child, depth, overlap, used)
                    if marks[first]:
                        stack.append(entry)
                    else:
                        stack.insert(0, entry)
        finally:
            marks[ranks] = False


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self._parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self._parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        self._parent[max(x, y)] = min(x, y)
        return x != y


def linked(sets: list[np.ndarray], probes: int, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that connect all sets which similar pairs connect.

    The last ``probes`` sets are compared with the others only, not among each other. A
    pair that earlier links already connect may be left out, no connection is.
    """
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    ranks = np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])
    tree, forest, found = PrefixTree(len(tokens), similarity), Forest(len(sets)), []
    inside: set[int] = set()  # roots of what the tree holds
    base = len(sets) - probes
    for x, own in enumerate(ranks):
        own = np.sort(own)
        for y in tree.similar(own):
            if forest.join(x, y):
                found.append((y, x))
                inside = {forest.root(r) for r in inside}
            if len(inside) == 1 and forest.root(x) in inside:
                break
        if x < base:
            tree.add(x, own)
            inside.add(forest.root(x))
    return found
